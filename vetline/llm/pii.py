"""Personal data: base patterns, and further spans by weak supervision.

Base spans come from fixed patterns and always stay. Other places that look similar are
candidates. Labelers (patterns, gazetteers, context words) vote on every span or abstain;
expectation-maximisation estimates how reliable each labeler is, and a classifier of span
features, trained on the resulting probabilities, decides on the candidates.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.llm.common import slices, stored, texts_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits does; looking behind keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates beyond the base patterns.
AT = r"\s?[\[({]\s?at\s?[\])}]\s?"
CANDIDATES = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{AT}|\sat\s)[A-Za-z0-9-]{{1,63}}"
                         r"(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[A-Za-z0-9-]{1,63}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}(?:[./_ ][0-9]{4}){3}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,5}\)|0?[0-9]{2,4})[ ./-]?[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z])")),
)
HINT = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]|\sat\s\S+(?:\sdot\s|\.)", re.I)

# Context words (before a span) and name endings.
SPEAKING = {
    "email": "email e-mail mail contact write correo courriel kontakt",
    "ip": "ip address host server login dirección adresse",
    "card": "card visa mastercard credit payment tarjeta carte karte",
    "phone": "phone tel telephone call mobile fax teléfono téléphone telefon fon handy",
}
SPEAKING = {k: frozenset(v.split()) for k, v in SPEAKING.items()}
AGAINST = frozenset("version order invoice isbn id ref section page token password key total price no nr code".split())
ENDINGS = frozenset("com org net edu gov info io eu de fr es uk us it nl ch at example".split())
WORD = re.compile(r"[^\W\d_][\w-]*")

LABELERS = ("pattern", "validity", "gazetteer", "context", "surroundings", "repetition")
YES, NO, ABSTAIN = 1, 0, -1
#: Bits of a feature code: four of the kind, then those of ``features``.
FEATURES = 12


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    ended, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > ended and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            ended = found.end()
            yield start, ended
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order: leftmost, per kind without overlaps."""
    found = [(i, 0, j) for i, j in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of further places, clear of base spans and of each other."""
    taken = sorted((i, j) for i, _, j in base)
    found = sorted(
        (m.start(), KINDS.index(kind), m.end()) for kind, pattern in CANDIDATES for m in pattern.finditer(text)
    )
    kept, ended, k = [], 0, 0
    for start, kind, end in found:
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start >= ended and (k == len(taken) or taken[k][0] >= end):
            kept.append((start, kind, end))
            ended = end
    return kept


def _before(text: str, start: int) -> list[str]:
    return [w.lower() for w in WORD.findall(text[max(0, start - 48) : start])[-3:]]


def votes(text: str, span: tuple[int, int, int], is_base: bool) -> list[int]:
    """One vote per labeler."""
    start, kind, end = span
    piece, digits = text[start:end], _digits(text[start:end])
    before, name = set(_before(text, start)), KINDS[kind]
    ending = re.split(r"[^A-Za-z]+", piece.rstrip())[-1].lower()
    validity = ABSTAIN
    if name == "card":
        validity = YES if luhn(digits) else NO
    elif name == "phone":
        validity = YES if 9 <= len(digits) <= 15 else NO
    elif name == "ip" and ":" in piece:
        validity = YES if piece.count(":") == 7 or "::" in piece else NO
    elif name == "ip":
        validity = YES
    gazetteer = ABSTAIN
    if name == "email":
        gazetteer = YES if ending in ENDINGS else NO
    context = YES if before & SPEAKING[name] else NO if before & AGAINST else ABSTAIN
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    repeated = len(digits) >= 6 and len(set(digits)) <= 2
    return [
        YES if is_base else NO if name == "phone" and not re.search(r"[ ()-]", piece) else ABSTAIN,
        validity, gazetteer, context,
        NO if any(c.isalnum() or c in "=/\"'#$" for c in around) else ABSTAIN,
        NO if repeated else ABSTAIN,
    ]


def features(text: str, span: tuple[int, int, int]) -> int:
    """A code of what the classifier sees; bits, the kind first."""
    start, kind, end = span
    piece, digits, before = text[start:end], _digits(text[start:end]), set(_before(text, start))
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    ending = re.split(r"[^A-Za-z]+", piece.rstrip())[-1].lower()
    bits = [kind == k for k in range(4)] + [
        len(digits) >= 10, len(set(digits)) > 2, bool(re.search(r"[ ()\-\[{]", piece)), piece[:1] in "+(",
        ending in ENDINGS, bool(before & SPEAKING[KINDS[kind]]), bool(before & AGAINST),
        any(c.isalnum() or c in "=/\"'#$" for c in around),
    ]
    return sum(1 << i for i, b in enumerate(bits) if b)


def reliabilities(patterns: np.ndarray, weights: np.ndarray, known: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(probability per pattern, P(vote yes | class) per labeler and class), by EM.

    ``patterns`` holds votes, ``weights`` how often each came up; where ``known`` the class
    is 1. Labelers count as independent given the class; an abstention says nothing.
    """
    cast, yes = patterns != ABSTAIN, patterns == YES
    share = np.where(known, 1.0, (yes.sum(1) + 0.5) / (cast.sum(1) + 1.0))
    rates = np.full((patterns.shape[1], 2), 0.5)
    for _ in range(rounds):
        for c, belief in ((0, 1 - share), (1, share)):
            mass = (weights * belief)[:, None]
            prior = 2.0 if c else 1.0  # one imagined vote against and one or two for
            rates[:, c] = ((mass * yes).sum(0) + prior) / ((mass * cast).sum(0) + prior + (1.0 if c else 2.0))
        open_ = ~known
        prior = ((weights * share)[open_].sum() + 1) / (weights[open_].sum() + 2)
        odds = np.log(prior / (1 - prior)) + (
            yes * np.log(rates[:, 1] / rates[:, 0]) + (cast & ~yes) * np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
        ).sum(1)
        new = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))))
        if np.abs(new - share).max(initial=0) < 1e-9:
            break
        share = new
    return share, rates


def _bits(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(FEATURES) & 1).astype(float)


def classifier(codes: np.ndarray, weights: np.ndarray, share: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model of the features (last: the constant), fitted to shares."""
    x = np.column_stack((_bits(codes), np.ones(len(codes))))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weights * p * (1 - p)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + ridge * np.eye(len(beta)), x.T @ (weights * (share - p)) - ridge * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return beta


SPAN = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()), T.StructField("votes", T.IntegerType()), T.StructField("features", T.IntegerType()),
])
_SPAN = pa.list_(pa.struct([
    ("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()),
    ("features", pa.int32()),
]))


def voted_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): base spans and candidates of every whole text, with votes and features."""

    def spans(text: str) -> list[dict]:
        if not HINT.search(text):
            return []
        base = base_spans(text)
        both = sorted([(s, True) for s in base] + [(s, False) for s in candidate_spans(text, base)])
        return [
            {"start": s[0], "kind": s[1], "end": s[2], "base": b,
             "votes": sum((v + 1) * 3**i for i, v in enumerate(votes(text, s, b))), "features": features(text, s)}
            for s, b in both
        ]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([spans(t) for t in texts_of(batch)], _SPAN)
            yield pa.record_batch([batch.column("doc_id"), found], ["doc_id", "spans"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(SPAN))])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def accepted_features(found: DataFrame) -> list[int]:
    """Feature codes that the trained classifier takes for personal data.

    Spans only reach the driver as counts per vote pattern and feature code, which are
    at most 3^6 times 2^12, however many spans there are.
    """
    rows = (
        found.select(F.explode("spans").alias("s")).groupBy("s.base", "s.votes", "s.features")
        .agg(F.count(F.lit(1)).alias("n")).orderBy("base", "votes", "features").collect()
    )
    if not rows:
        return []
    base, coded, codes, n = (np.array(c) for c in zip(*rows))
    patterns = coded[:, None] // 3 ** np.arange(len(LABELERS)) % 3 - 1
    share, _ = reliabilities(patterns, n.astype(float), base.astype(bool))
    beta = classifier(codes, n.astype(float), share)
    seen = np.unique(codes)
    return [int(c) for c, z in zip(seen, np.column_stack((_bits(seen), np.ones(len(seen)))) @ beta) if z >= 0]


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    Counts and ``base_sha256`` are of the base spans, written kind:start:end (code points,
    end exclusive) by start, then kind as in KINDS, joined by commas; ``spans`` holds base
    and added spans likewise. A null text counts as empty. Rows are handled one by one:
    null keys, ties and repeated rows need no care, but all spans of the table train the
    classifier. Other columns are ignored; an empty table gives an empty result.
    """
    found = stored(voted_spans(docs), "spans")
    accepted = F.array(*[F.lit(c) for c in accepted_features(found)]).cast("array<int>")
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
        )

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind))

    base = F.filter("spans", lambda s: s["base"])
    final = F.filter("spans", lambda s: s["base"] | F.array_contains(accepted, s["features"]))
    return found.select(
        "doc_id",
        *[count(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(written(base), 256).alias("base_sha256"), written(final).alias("spans"),
    )
