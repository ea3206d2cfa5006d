"""Secret scanning with a random forest against false positives.

Candidates are runs of at least 16 key characters that hold a digit or mix cases, and
whatever unbroken value of 6 characters or more a key word and a separator introduce
(password = "...").  Each is described by its length and characters, by how likely its letter transitions are in
the corpus's words, by how much of it dictionary words cover, by the words before it and
what sets it off, and by its document's path; a random forest trained on labelled
findings tells secrets from hashes, identifiers, placeholders and long words.

The dictionary and the transitions are one summary of all documents' words of a fixed
size.  The forest is fitted on at most `MOST_LABELLED` labelled findings, by default
made ones (made_findings).
"""

from __future__ import annotations

import base64
import math
import random
import re
import uuid
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.token_counts import frequent, summary
from quern.session import shared_path

MOST_LABELLED = 20_000
MADE = 3000
WORDS = 8192
TREES, DEPTH = 40, 8
CANDIDATE = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("candidate", pa.string()), ("features", pa.list_(pa.float64()))])
FOUND_SQL = "doc_id long, start long, length int, candidate string, features array<double>"
#: Words that come before secrets, and before what looks like them.
KEYS = frozenset("key apikey api_key token access_token auth_token secret client_secret password passwd pwd credential credentials auth authorization bearer private_key access_key secret_key".split())
OTHERS = frozenset("commit sha sha1 sha256 md5 hash digest fingerprint checksum integrity uuid guid id etag revision rev version build example sample placeholder test trace request session isbn doi blob tree parent merge".split())
VALUE = re.compile(rf"(?i)(?:{'|'.join(sorted(KEYS, key=lambda k: (-len(k), k)))})[\"'`]?\s{{0,8}}[:=]\s{{0,8}}[\"'`]?([^\s\"'`,;<>(){{}}]{{6,}})")
SAMPLES = re.compile(r"(^|[/_.-])(test|tests|spec|example|examples|fixture|fixtures|mock|docs?)([/_.-]|$)", re.IGNORECASE)


def words_of(text: str) -> list[str]:
    return [w for w in text.lower().split() if len(w) > 3 and w.isalpha()]


class Language:
    """Letter transitions and words, from word counts."""

    def __init__(self, counts: dict[str, int]):
        self.words = frozenset(counts)
        pairs, single = Counter(), Counter()
        for w, n in counts.items():
            for a, b in zip(w, w[1:]):
                pairs[a + b] += n
                single[a] += n
        self.step = {p: math.log((n + 1) / (single[p[0]] + 40)) for p, n in pairs.items()}
        self.none = {a: math.log(1 / (n + 40)) for a, n in single.items()}

    def likelihood(self, s: str) -> float:
        """Mean log probability of the letter transitions; those with other characters count as 1 in 64."""
        s = s.lower()
        got = [self.step.get(a + b, self.none.get(a, -4.16)) if a.isalpha() and b.isalpha() else -4.16 for a, b in zip(s, s[1:])]
        return sum(got) / max(1, len(got))

    def covered(self, s: str) -> float:
        """Share of the characters that words of four letters or more cover, longest first from the left."""
        s, n, i = s.lower(), 0, 0
        while i + 4 <= len(s):
            k = next((k for k in range(min(16, len(s) - i), 3, -1) if s[i : i + k] in self.words), 0)
            n += k
            i += k or 1
        return n / len(s)


def describe(text: str, start: int, end: int, path: str, language: Language) -> list[float]:
    """The features of the candidate text[start:end]."""
    s = text[start:end]
    n = len(s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in s]
    share = Counter(kinds)
    switches = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    steps = sum(ord(b) - ord(a) in (0, 1) for a, b in zip(s, s[1:])) / n
    before = text[max(0, start - 60) : start]
    near = [w for w in re.split(r"[^a-z0-9_]+", before.lower()) if w][-3:]
    tail = before.rstrip("\"'` ")
    return [
        math.log2(n), share["d"] / n, share["u"] / n, share["l"] / n, share["s"] / n, float(all(c in "0123456789abcdefABCDEF" for c in s)), entropy,
        language.likelihood(s), language.covered(s), switches, steps,
        float(any(w in KEYS or w.rpartition("_")[2] in KEYS for w in near)), float(any(w in OTHERS for w in near)),
        float(tail[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'", "`")), float(bool(re.search(r"(://|[/\\?&#])\S*$", before))),
        float(bool(SAMPLES.search(path))), float("=" in s[:-2] or s.count("-") == 4 or "/" in s), float(n < 16), len(counts) / n,
    ]


def candidates(text: str):
    """(start, end) in order; a value after a key word holds the runs inside it."""
    values = [m.span(1) for m in VALUE.finditer(text)]
    runs = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) or not (s.islower() or s.isupper() or s[1:].islower()):
            runs.append(m.span())
    at = 0
    for a, b in runs:
        while at < len(values) and values[at][1] <= a:
            yield values[at]
            at += 1
        if at == len(values) or values[at][0] >= b:
            yield a, b
    yield from values[at:]


def made_findings(n: int = MADE, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """n labelled findings (text, start, end, path, label), half of them secrets."""
    r = random.Random(seed)
    low, hex_, every = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    take = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: "".join(r.choice(("ra", "te", "lo", "min", "sta", "con", "er", "ing", "the", "pro", "ver", "al", "ment")) for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        lead = " ".join(word() for _ in range(r.randint(0, 6)))
        tail = " ".join(word() for _ in range(r.randint(0, 6)))
        if i % 2:
            s = r.choice((
                lambda: take(hex_, r.choice((32, 40, 64))), lambda: take(every, r.randint(20, 48)), lambda: take(every + "+/", r.randint(38, 42)) + "=",
                lambda: r.choice(("", "p", "Q")) + take(every + "!@#$%^&*.?_-", r.randint(8, 14)) + r.choice(("!", "7", "#")), lambda: take(low, r.randint(18, 30)),
                lambda: "AKIA" + take(every[:26] + every[-10:], 16), lambda: r.choice(("ghp_", "glpat-", "xoxb-", "sk_live_")) + take(every, 32), lambda: take(low + "0123456789", r.randint(24, 40)),
            ))()
            key = r.choice(sorted(KEYS))
            plain = any(c.isdigit() for c in s) and len(s) >= 16 and all(c.isalnum() or c in "_+/-=" for c in s)  # found without a separator too
            before = r.choice((f'{key} = "', f"{key}: ", f"{key}='", f"{key}=", f'"{key}": "', f"{key.upper()}=", *([f"{key} "] if plain else [])))
            path = r.choice(("src/config.py", "settings.env", "deploy.yaml", "src0", "app/main.js", ""))
        else:
            kind = r.randrange(9)
            s = (
                take(hex_, r.choice((32, 40, 64))), take(hex_.upper(), 40), str(uuid.UUID(int=r.getrandbits(128))), "_".join(word() for _ in range(4)) + take("0123456789", 2),
                r.choice(("your_api_key_goes_here0", "xxxxxxxxxxxxxxxxxxxx1", "0000000000000000000000", "abcdefghijklmnop123456", "1234567890123456789")), word().title() + word().title() + word().title() + word() + "2", base64.b64encode(" ".join(word() for _ in range(6)).encode()).decode().rstrip("="),
                take("0123456789", r.randint(16, 20)), r.choice(("changeme", "required", "os.environ", "${PASSWORD}", "********", "process.env.KEY", "undefined", "password", "example")),
            )[kind]
            other = r.choice(sorted(OTHERS))
            before = r.choice((f"{other} ", f"{other}: ", f"{other}=", "", "https://example.com/a/", "see ")) if kind not in (4, 8) else f'{r.choice(sorted(KEYS))} = "' if kind == 8 or r.random() < 0.5 else ""
            path = r.choice(("tests/fixtures/a.py", "docs/readme.md", "src0", "package-lock.json", "src/lib.rs", ""))
        if len(s) < 16 and not i % 2 and kind != 8:
            s += take(low, 16 - len(s)) + "1"
        text = f"{lead} {before}"
        out.append((f"{text}{s}{chr(34) if before.endswith(chr(34)) else ''} {tail}", len(text), len(text) + len(s), path, i % 2))
    return out


def fit(spark: SparkSession, language: Language, labelled: list[tuple[str, int, int, str, int]], seed: int = 3) -> RandomForestClassificationModel:
    """A forest on labelled findings; none, or more than MOST_LABELLED, are refused."""
    if not 0 < len(labelled) <= MOST_LABELLED:
        raise ValueError(f"{len(labelled)} labelled findings; from 1 to {MOST_LABELLED} are fitted on")
    rows = pd.DataFrame({"features": [describe(t, a, b, p, language) for t, a, b, p, _ in labelled], "label": [float(x[-1]) for x in labelled]})
    frame = spark.createDataFrame(rows, "features array<double>, label double").coalesce(1).select(array_to_vector("features").alias("features"), "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featuresCol="features", labelCol="label").fit(frame)
    path = shared_path(spark, "forest")
    model.write().save(path)  # a fitted model's summary holds its session; a loaded one has none
    return RandomForestClassificationModel.load(path)


def scan(docs: DataFrame, labelled: list[tuple[str, int, int, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, candidate, score, is_secret for every candidate of every text.

    start counts characters from 0.  Null and empty texts have no candidates; repeated
    rows repeat theirs; a null doc_id stays null; a table without a `source` column has
    empty paths; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), path.alias("path"))
    counts = dict(frequent(docs, lambda texts, k: summary(texts, words_of, k), WORDS))
    model = fit(spark, Language(counts), made_findings() if labelled is None else labelled)
    shared = spark.sparkContext.broadcast(counts)
    opened: dict = {}

    def task(batches):
        if not opened:
            opened["l"] = Language(shared.value)
        for b in batches:
            cols: list[list] = [[] for _ in FOUND]
            for d, t, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for start, end in candidates(t) if t else ():
                    for c, v in zip(cols, (d, start, end - start, t[start:end], describe(t, start, end, p, opened["l"])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, FOUND, strict=True)], schema=FOUND)

    found = docs.mapInArrow(task, FOUND_SQL).withColumn("features", array_to_vector("features"))
    score = F.get(vector_to_array("probability"), 1)
    return model.transform(found).select("doc_id", "start", "length", "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))
