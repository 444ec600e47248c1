"""Collected web pages to posting columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.functions.text import WS_RUN, strip
from vetline.operators.clean import with_missing_columns
from vetline import schema

# The entities that stand for markup characters; & comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def plain_text(html: Column) -> Column:
    """Markup to text: scripts, styles and comments go, tags become spaces."""
    c = html
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        c = F.regexp_replace(c, pattern, " ")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(c, WS_RUN, " "))


def _element(html: Column, tag: str) -> Column:
    """Content of the first such element, null where there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.when(inner != "", inner)


# What a page may call a posting column, in lower case.
LABELS = {
    "location": ["location", "job location", "place of work"],
    "department": ["department", "team"],
    "salary_range": ["salary", "salary range", "compensation", "pay"],
    "company_profile": ["company", "company profile", "about the company"],
    "requirements": ["requirements", "qualifications", "skills"],
    "benefits": ["benefits", "perks"],
    "telecommuting": ["remote", "telecommuting", "home office"],
    "employment_type": ["employment type", "job type", "contract type"],
    "required_experience": ["experience", "required experience", "seniority"],
    "required_education": ["education", "required education"],
    "industry": ["industry", "sector"],
    "function": ["function", "job function", "category"],
}
YES = ["yes", "true", "t", "1", "remote"]
#: The part of an embedded posting (schema.org vocabulary) that has a column here.
EMBEDDED = """title string, description string, employmentType string, industry string, occupationalCategory string,
    experienceRequirements string, educationRequirements string, qualifications string, jobBenefits string,
    jobLocationType string, hiringOrganization struct<name:string,description:string,department:string,logo:string>,
    jobLocation struct<address:struct<addressCountry:string,addressRegion:string,addressLocality:string>>,
    baseSalary struct<value:struct<minValue:string,maxValue:string>>"""


def _labelled(html: Column) -> Column:
    """Array of (label, value) from definition lists and two-column table rows, as plain text."""
    found = []
    for first, second in ((r"<dt[^>]*>(.*?)</dt>\s*", r"<dd[^>]*>(.*?)</dd>"),
                          (r"<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*", r"<td[^>]*>(.*?)</td>")):
        pattern = F.lit(f"(?is){first}{second}")
        sides = [F.transform(F.regexp_extract_all(html, pattern, F.lit(i)), plain_text) for i in (1, 2)]
        found.append(F.zip_with(*sides, lambda a, b: F.struct(
            F.lower(F.regexp_replace(a, r"\s*:\s*$", "")).alias("label"), b.alias("value"))))
    return F.concat(*found)


def _range(text: Column) -> Column:
    """Two numbers as low-high, whatever stands around them; other texts as they are."""
    numbers = F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.when(F.size(numbers) == 2, F.array_join(numbers, "-")).otherwise(text)


def posting_fields(html: Column) -> dict[str, Column]:
    """Posting columns that a page states: from an embedded posting, else from labels; null elsewhere.

    A flag is 't' where the page says so, 'f' where a label denies it.
    """
    script = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    data, pairs = F.from_json(script, EMBEDDED), _labelled(html)

    def stated(column: str) -> Column:
        own = F.filter(pairs, lambda p: p["label"].isin(LABELS[column]) & (p["value"] != ""))
        return F.get(own, F.lit(0))["value"]

    place = data["jobLocation"]["address"]
    parts = [place[c] for c in ("addressCountry", "addressRegion", "addressLocality")]
    pay, firm = data["baseSalary"]["value"], data["hiringOrganization"]
    remote = stated("telecommuting")
    embedded = {
        "location": F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(", ", *[F.coalesce(c, F.lit("")) for c in parts])),
        "salary_range": F.concat(pay["minValue"], F.lit("-"), pay["maxValue"]),
        "department": firm["department"],
        "company_profile": F.coalesce(firm["description"], firm["name"]),
        "requirements": data["qualifications"],
        "benefits": data["jobBenefits"],
        "employment_type": data["employmentType"],
        "required_experience": data["experienceRequirements"],
        "required_education": data["educationRequirements"],
        "industry": data["industry"],
        "function": data["occupationalCategory"],
    }
    fields = {c: F.coalesce(v, _range(stated(c)) if c == "salary_range" else stated(c)) for c, v in embedded.items()}
    fields["telecommuting"] = F.when(data["jobLocationType"] == "TELECOMMUTE", "t").otherwise(
        F.when(remote.isNotNull(), F.when(F.lower(remote).isin(YES), "t").otherwise("f")))
    fields["has_company_logo"] = F.when(firm["logo"].isNotNull(), "t")
    return fields


def pages_to_postings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages in the raw posting schema: title, description and the fields that a page states; the rest missing."""
    c = F.col(html)
    found = pages.select(
        F.col(key).alias("job_id"),
        plain_text(F.coalesce(_element(c, "title"), _element(c, "h1"))).alias("title"),
        plain_text(F.coalesce(_element(c, "article"), _element(c, "body"), c)).alias("description"),
        *[v.alias(name) for name, v in posting_fields(c).items()],
    )
    return with_missing_columns(found).select("job_id", *schema.RAW_COLUMNS)
