"""Secret scans: fixed patterns plus character Markov models.

Two second-order character models, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a long token whose log-likelihood ratio exceeds a cut that
was calibrated on other labelled samples is a secret of kind ``markov``.

The samples: label 0 are the letter-only words of a bounded sample of rows labelled good, alone
and joined in the usual identifier styles, plus programming words and plain numbers; label 1
are random strings over the usual secret alphabets from a fixed seed, plus what the fixed patterns
find in the same rows.  One fourth of each calibrates the cut.

Defined results: a null text counts as empty and has no span; repeated rows are scanned
alike; offsets are code points, ends exclusive; texts of any length are scanned whole; an empty table
gives an empty result; without labelled rows the built-in words alone stand for ordinary identifiers;
a score that equals the cut is ordinary; extra columns pass through unread, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnhelm.llm import batches, samples

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What the Markov models judge.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "markov")
#: Bound on the labelled rows whose words train the model of ordinary identifiers.
MOST_ROWS = 400

#: Ordinary programming words.
PROGRAMMING_WORDS = """
access account action add address admin after alert all allow app append apply archive array async auth back base batch before begin
binary block body boolean bottom bound box branch break bucket buffer build bundle button byte cache call cancel case catch center change
channel char check child class clean clear click client clone close cluster code collect color column command comment commit common
compare compile complete component config confirm connect const consumer container content context control convert cookie copy core count
create current custom data database date debug default define delete deploy depth description detail device dialog diff digest directory
disable display document domain double down download drag draw driver drop edge edit element empty enable encode end engine entry enum
environment error event exception execute exit expand export factory fallback false feature fetch field file filter final find first flag
float flow flush folder font footer form format forward frame from function future gateway generate get global grid group handle handler
hash header height hidden hook host html icon identifier image import index info init inner input insert instance int interface internal
invalid item iterator job join key kind label language last layer layout left length level library limit line link list listener load local
location lock log logger login long loop main manager map mask master match max menu merge message meta method metric middle min mock mode
model module monitor mouse move name namespace native network new next node normal notification null number object offset old open operator
option order origin output override owner package page panel parameter parent parse part password patch path pattern payload pending
permission pipeline plan player plugin point policy pool popup port position post prefix prepare press preview previous print priority
private process producer profile progress project promise property protocol provider proxy public push query queue random range rate raw
read ready record reduce reference refresh region register release remote remove rename render repeat replace report request reset resize
resolve resource response result resume retry return right role root route row rule run runtime sample save scale schedule schema scope
screen script scroll search section select selector sender sequence serial server service session set setting shape share shift show sign
signal simple single size skip slot sort source space split stack stage start state static status step stop storage store stream string
style submit suffix summary switch symbol sync system table tag target task template terminal test text theme thread time timeout timer
title toggle token tool top total trace track transaction transfer transform tree trigger true type unit update upload upper user util
valid validate value variable vector verify version view visible wait warning watch wheel width window wrapper write zone
""".split()


class Markov:
    """Second-order log-probabilities, each order smoothed towards the one below it.

    A pair that was never seen costs what its single characters cost after one another, so an
    improbable change of character kinds is paid for at every step.
    """

    def __init__(self, tokens: list[str], strength: float = 2.0):
        n = self.n = 128
        # Two start marks before each token; no step leads into one.
        c = np.frombuffer(b"".join(b"\0\0" + t.encode("ascii", "replace") for t in tokens) or b"\0\0", np.uint8).astype(np.int64)
        step = np.flatnonzero(c[2:]) + 2
        three = np.zeros((n * n, n))
        np.add.at(three, (c[step - 2] * n + c[step - 1], c[step]), 1)
        two = three.reshape(n, n, n).sum(0)
        one = two.sum(0) + 0.5
        p = np.broadcast_to(one / one.sum(), (n, n))
        p = (two + strength * p) / (two.sum(1, keepdims=True) + strength)
        three = (three + strength * np.tile(p, (n, 1))) / (three.sum(1, keepdims=True) + strength)
        self.logs = np.log(three).astype(np.float32)

    @staticmethod
    def points(t: str) -> np.ndarray:
        """Characters with two start marks."""
        return np.concatenate([[0, 0], np.frombuffer(t.encode("ascii", "replace"), np.uint8)]).astype(np.int64)


class Detector:
    """Two models and the cut on their log-likelihood ratio a character.

    Three fourths of either sample train, one fourth calibrates: the cut lies between the
    highest of the ordinary ones but for the share ``tolerance`` and the random ones' quantile of 0.02.
    """

    def __init__(self, random_: list[str], ordinary: list[str], tolerance: float = 0.0):
        a, b = (Markov([t for i, t in enumerate(x) if i % 4]) for x in (random_, ordinary))
        self.ratio, self.n = a.logs - b.logs, a.n
        r = np.sort([self.score(t) for t in random_[::4]])
        o = np.sort([self.score(t) for t in ordinary[::4] if len(t) >= 20] or [0.0])
        low = float(o[min(len(o) - 1, int(len(o) * (1 - tolerance)))])
        high = float(r[int(len(r) * 0.02)])
        self.cut = (low + high) / 2 if high > low else float(np.nextafter(low, np.inf))
        self.recall = float((r > self.cut).mean())
        self.false_rate = float((o > self.cut).mean())

    def score(self, token: str) -> float:
        c = Markov.points(token)
        return float(self.ratio[c[:-2] * self.n + c[1:-1], c[2:]].mean()) if len(c) > 2 else 0.0

    def is_secret(self, token: str) -> bool:
        return self.score(token) > self.cut


def random_strings(n: int = 6000, seed: int = 11) -> list[str]:
    rng = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = (lower + upper + digits + "+/", lower + upper + digits, digits + "abcdef", lower + digits, upper + digits, lower + upper + digits + "-_", digits + "ABCDEF")
    out = []
    for i in range(n):
        a = alphabets[i % len(alphabets)]
        out.append("".join(a[j] for j in rng.integers(0, len(a), int(rng.integers(20, 65)))))
    return out


def identifiers(words: list[str], n: int = 12_000, seed: int = 13) -> list[str]:
    """Words as they stand and joined: snake, kebab, camel, constants, paths and with counters; plain numbers."""
    rng = np.random.default_rng(seed)
    out = [w for w in words if len(w) >= 3]
    pools = [words or PROGRAMMING_WORDS, PROGRAMMING_WORDS]
    for i in range(n):
        pool = pools[i % 2]
        part = [pool[j] for j in rng.integers(0, len(pool), int(rng.integers(2, 7)))]
        low = [p.lower() for p in part]
        out.append((
            "_".join(low), "-".join(low), low[0] + "".join(p.capitalize() for p in low[1:]), "_".join(low).upper(), "/" + "/".join(low),
            "".join(p.capitalize() for p in low), "_".join(low) + "_" + str(int(rng.integers(0, 10000))), "/".join(low) + "/" + str(2000 + i % 30),
            "=" * int(rng.integers(20, 80)), "-" * int(rng.integers(20, 80)), "_" * int(rng.integers(20, 60)),
        )[i // 2 % 11])
        if i % 8 == 0:
            out.append("".join(str(d) for d in rng.integers(0, 10, int(rng.integers(10, 41)))))
    return out


class _Words:
    WORD = re.compile(r"(?<![^\s])[A-Za-z]{3,}(?![^\s.,;:!?])")

    def __call__(self, c: dict) -> dict:
        found = [[m[2] for m in ASSIGN.finditer(t) if len(m[2]) >= 20] + ACCESS.findall(t) + HEX.findall(t) for t in c["text"]]
        return {"words": [list(dict.fromkeys(self.WORD.findall(t))) for t in c["text"]], "secrets": found}


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Detector:
    """The detector from the whole texts of at most ``most`` rows labelled good."""
    rows = samples.labelled(docs, labels.where("quality = 1"), "quality", most)
    got = batches.map_rows(rows, [batches.text_column()], _Words, "words array<string>, secrets array<string>").collect()
    words = sorted({w for r in got for w in r["words"]})
    found = sorted({w for r in got for w in r["secrets"]})
    return Detector(random_strings() + found, identifiers(PROGRAMMING_WORDS + words))


Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind's place, end) of the fixed patterns, in that order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, base: list[Span], detector: Detector) -> list[Span]:
    """The base spans and the Markov models' ones that no base span covers."""
    more = [
        (m.start(), 3, m.end()) for m in TOKEN.finditer(text)
        if not any(s <= m.start() and m.end() <= e for s, _, e in base) and detector.is_secret(m[0])
    ]
    return sorted(base + more)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


class _Scan:
    def __init__(self, detector: Detector, redact: bool):
        self.detector, self.redact = detector, redact

    def __call__(self, texts: list[str]) -> dict:
        base = [base_spans(t) for t in texts]
        full = [all_spans(t, b, self.detector) for t, b in zip(texts, base)]
        if self.redact:
            return {"clean": [redacted(t, x) if x else None for t, x in zip(texts, full)]}
        out: dict[str, list] = {name: [sum(x == k for _, x, _ in spans) for spans in full] for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_markov"))}
        out["base_sha256"] = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
        out["spans"] = [written(x) for x in full]
        return out


COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def scan(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id and the spans, one row per document, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(detector)  # of fixed size
    got = batches.append(docs.select("doc_id", "text"), lambda: _Scan(held.value, False), COLUMNS)
    return got.select(F.col("_0").alias("doc_id"), *[x.split()[0] for x in COLUMNS.split(", ")])


def remove_secrets(docs: DataFrame, detector: Detector) -> DataFrame:
    """The documents with every secret replaced by a mark; ``n_chars``, if there is one, follows the text."""
    held = docs.sparkSession.sparkContext.broadcast(detector)
    got = batches.append(docs, lambda: _Scan(held.value, True), "clean string")
    at = {n: F.col(f"_{i}") for i, n in enumerate(docs.columns)}
    new = {"text": F.coalesce("clean", at["text"])}
    if "n_chars" in at:
        new["n_chars"] = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), at["n_chars"])
    return got.select(batches.own_columns(docs.columns, **new))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
