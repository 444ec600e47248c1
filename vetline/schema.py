"""The posting table: column lists, token lists and code tables."""

from pyspark.sql import types as T

# The raw posting columns, in file order.
RAW_COLUMNS = [
    "title", "location", "department", "salary_range", "company_profile",
    "description", "requirements", "benefits", "telecommuting",
    "has_company_logo", "has_questions", "employment_type",
    "required_experience", "required_education", "industry", "function",
    "fraudulent", "in_balanced_dataset",
]

# Every raw column is read as a string; type inference would make the binary
# columns differ from one file to the next.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

# Cells that mean "missing" (whole cell, case-sensitive, untrimmed).
NULL_TOKENS = ["", " ", "none", "None", "NaN", "unknown", "Unknown"]

# Cells a CSV reader treats as missing by default.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Accepted spellings of the binary flags.
TRUE_TOKENS = ["t", "true", "1"]
FALSE_TOKENS = ["f", "false", "0"]

# Columns by kind.
BINARY_COLUMNS = [
    "telecommuting", "has_company_logo", "has_questions",
    "fraudulent", "in_balanced_dataset",
]
TEXT_COLUMNS = ["description", "requirements", "benefits", "company_profile"]
MISSING_TEXT = "Unspecified"
MISSING_CATEGORY = "Unknown"

# Ordinal codes of the categories (alphabetical).
EMPLOYMENT_CODES = {
    "Contract": 0,
    "Full-time": 1,
    "Other": 2,
    "Part-time": 3,
    "Temporary": 4,
    "Unknown": 5,
}
EDUCATION_CODES = {
    "Associate Degree": 0,
    "Bachelor's Degree": 1,
    "Certification": 2,
    "Doctorate": 3,
    "High School or equivalent": 4,
    "Master's Degree": 5,
    "Professional": 6,
    "Some College Coursework Completed": 7,
    "Some High School Coursework": 8,
    "Unknown": 9,
    "Unspecified": 10,
    "Vocational": 11,
    "Vocational - Degree": 12,
    "Vocational - HS Diploma": 13,
}
# Fixed value: median salary midpoint of the training table.
TRAIN_SALARY_MEDIAN = 44000.0

# The four scored features; the order is part of the model contract.
FEATURES = [
    "salary_processed", "employment_type", "has_company_logo", "required_education",
]

# Columns of the one-hot metadata model.
METADATA_COLUMNS = [
    "location", "telecommuting", "has_company_logo", "has_questions",
    "employment_type", "required_experience", "required_education",
    "industry", "function",
]

# Leftovers of word-processor markup, dropped from word counts.
JUNK_WORDS = [
    "lsdexception", "locked", "false", "priority", "semihidden",
    "unhidewhenused", "name", "unhide", "latentstyles", "qformat",
    "accent", "heading", "grid", "table", "light", "medium", "dark",
]

# Spark ML's English stop words, dropped from word counts and the text model.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd "
    "he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't "
    "weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot "
    "could here's how's let's ought that's there's what's when's where's who's why's would"
).split()

# Swept parameters.
CONTAMINATIONS = [0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.10]
NEIGHBOUR_COUNTS = [10, 15, 20, 30]
CUTOFF_PERCENTILES = [85, 88, 90, 92, 95]
