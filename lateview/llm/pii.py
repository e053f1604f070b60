"""Personal data by weak supervision.

Regular expressions propose candidates; labelers (pattern, validity, gazetteer, context,
boundary) vote for, against or not at all; expectation-maximisation over the counts of all vote
patterns in the corpus estimates how reliable each labeler is; the posteriors train a logistic
span classifier on categorical features. Base spans (the strict patterns) always stand; the
classifier decides on the wider candidates: veiled e-mail, local phone, long IP, bank account and
social security numbers, and secrets (what a key, token or password is set to, and the shapes of well-known keys).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.llm.common import slices, table

#: Kinds with a base pattern, and those that the method alone finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a run of digits is tried from its start alone, which changes no match and keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# a plain " at " is an address only with a veiled dot: "look at this. Then" and "meet at example.org" are none
_LABEL, _DOT = r"[A-Za-z0-9-]{1,63}", r"(?:\(dot\)|\[dot\]|\{dot\}| dot )"
_VEILED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:\s?(?:\(at\)|\[at\]|\{{at\}})\s?{_LABEL}(?:\s?(?:\.|{_DOT})\s?{_LABEL}){{1,4}}"
    rf"|\s? at \s?{_LABEL}(?:\.{_LABEL}){{0,3}}\s?{_DOT}\s?{_LABEL}(?:\s?(?:\.|{_DOT})\s?{_LABEL}){{0,3}})",
    re.I,
)
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\s?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")

# a name that speaks of a secret, then what it is set to
_ASSIGNED = re.compile(
    r"(?i:token|secret|passwor[dt]|passwd|passphrase|pwd|api[ _-]?key|apikey|access[ _-]?key|private[ _-]?key|client[ _-]?key|credentials?|authorization|bearer)"
    r"[\"']?(?:\s{0,2}[:=]>?\s{0,2}(?i:bearer\s)?|\s(?=[A-Za-z0-9_+/=.~-]{24}))[\"']?([A-Za-z0-9_+/=.~!@#$%^&*-]{8,512})"
)
_KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36,255}|sk_(?:live|test)_[A-Za-z0-9]{16,255}|xox[abprs]-[A-Za-z0-9-]{10,255}"
    r"|eyJ[A-Za-z0-9_-]{8,4096}\.eyJ[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{8,4096}|-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,8192}-----END [A-Z ]{0,32}PRIVATE KEY-----)"
)
_NAMED = ("token", "secret", "passwor", "passwd", "passphrase", "pwd", "key", "credential", "authorization", "bearer")
_KEYED = ("AKIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "sk_", "xox", "eyJ", "PRIVATE KEY")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")

#: Small gazetteers of the labelers, and words that speak for or against a kind just before a span.
_TOP = frozenset("com org net edu gov io de fr es it uk us eu info biz co ch at nl be".split())
_PREFIX = re.compile(r"3[47]|4|5[1-5]|2[2-7]|6")
_COUNTRIES = re.compile(r"1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]")
_FOR = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|adresse", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax|telefon|appel", re.I),
    "secret": re.compile(r"token|secret|pass|pwd|key|credential|auth|bearer|login", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta|transfer", re.I),
    "ssn": re.compile(r"\bssn\b|social|security|insured|taxpayer", re.I),
}
_AGAINST = re.compile(r"version|release|isbn|order|serial|build|chapter|section|example|placeholder|sample", re.I)
#: Countries whose account numbers begin with their code.
_BANKS = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR".split())


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def _entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def _remainder(account: str) -> int:
    """Of a bank account number by 97; 1 if it is sound."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, from one @ to the next."""
    last, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > last and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = t.find("@", m.end() if m else at + 1)


def candidates(t: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, form`` of all candidates: form ``base``, ``failed`` (base shape, failed check) or ``wide``."""
    out = [(a, b, "email", "base") for a, b in _emails(t)] if "@" in t else []
    low: list[tuple[int, int, str, str]] = []
    plain = t.lower()
    if "(at)" in plain or "[at]" in plain or "{at}" in plain or " at " in plain and any(d in plain for d in ("(dot)", "[dot]", "{dot}", " dot ")):
        low += [(m.start(), m.end(), "email", "wide") for m in _VEILED.finditer(t)]
    if any(name in plain for name in _NAMED):
        low += [(*m.span(1), "secret", "wide") for m in _ASSIGNED.finditer(t)]
    if any(mark in t for mark in _KEYED):
        low += [(*m.span(), "secret", "wide") for m in _KEY.finditer(t)]
    if _DIGIT.search(t):
        if "." in t:
            for m in _IP.finditer(t):
                out.append((*m.span(), "ip", "base" if _octets(m.group()) else "failed"))
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14:
                d = _digits(m.group())
                if 14 <= len(d) <= 19:
                    out.append((*m.span(), "card", "base" if _luhn(d) else "failed"))
        if "+" in t:
            for m in _PHONE.finditer(t):
                out.append((*m.span(), "phone", "base" if 10 <= len(_digits(m.group())) <= 15 else "failed"))
        low += [(*m.span(), "phone", "wide") for m in _LOCAL_PHONE.finditer(t)]
        low += [(*m.span(), "iban", "wide") for m in _IBAN.finditer(t)]
        if "-" in t:
            low += [(*m.span(), "ssn", "wide") for m in _SSN.finditer(t)]
        if ":" in t:
            low += [(*m.span(), "ip", "wide") for m in _LONG_IP.finditer(t)]
    if low:  # a wide candidate gives way to what it overlaps
        low.sort()
        taken = sorted((a, b) for a, b, _, f in out if f == "base")
        stop = -1
        k = 0
        for a, b, kind, form in low:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if a >= stop and not (k < len(taken) and taken[k][0] < b):
                out.append((a, b, kind, form))
                stop = b
    return out


def votes_and_features(t: str, start: int, end: int, kind: str, form: str) -> tuple[str, str]:
    """The labelers' votes (a string of + - 0) and the categorical features of one candidate."""
    s = t[start:end]
    before, after = t[start - 1 : start], t[end : end + 1]
    near = t[max(0, start - 40) : start]
    glued = before.isalnum() or after.isalnum()
    against = bool(_AGAINST.search(near))
    context = "+" if _FOR[kind].search(near) else "-" if against else "0"
    d = _digits(s)
    pattern = {"base": "+", "failed": "-", "wide": "0"}[form]
    if kind == "card":
        valid = "+" if _luhn(d) else "-"
        listed = "+" if _PREFIX.match(d) else "-"
    elif kind == "ip":
        valid = "+" if form != "failed" else "-"
        listed = "-" if s.startswith("0.") else "0" if form == "wide" else "+"
    elif kind == "phone":
        valid = "+" if 10 <= len(d) <= 15 else "-"
        listed = "+" if (_COUNTRIES.match(d) if s[0] == "+" else d[0] not in "01") else "-"
    elif kind == "secret":
        # made by a machine: many different characters, letters and digits mixed
        valid = "+" if len(s) >= 16 and _entropy(s[:512]) >= 3 else "-"
        listed = "+" if _KEY.match(s) or (d and re.search("[A-Za-z]", s)) else "-"
    elif kind == "iban":
        account = s.replace(" ", "")
        valid = "+" if 15 <= len(account) <= 34 and _remainder(account) == 1 else "-"
        listed = "+" if account[:2] in _BANKS else "-"
    elif kind == "ssn":
        valid = "+" if d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000" else "-"
        listed = "-" if d[0] == "9" else "0"
    else:
        valid = "+" if s[0] not in ".-%+" and ".." not in s else "-"
        listed = "+" if re.split(r"[^A-Za-z0-9]+", s.lower())[-1] in _TOP else "0"
    votes = pattern + valid + listed + context + ("-" if glued else "+")
    side = lambda c: "e" if not c else "s" if c.isspace() else "a" if c.isalnum() else "p"
    features = ",".join(
        (kind, kind + form, kind + "v" + valid, kind + "g" + listed, "c" + context, "x" + "ny"[against], "l" + side(before), "r" + side(after), kind + "n" + str(min(5, len(s) // 8)))
    )
    return votes, features


def label_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, votes, features, n`` over every candidate of every whole text.

    There are a few thousand combinations at most, whatever the corpus; each task adds up its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for v in b.column(0):
                t = v.as_py()
                for a, z, kind, form in candidates(t) if t else ():
                    seen[(kind, *votes_and_features(t, a, z, kind, form))] += 1
        if seen:
            keys = list(zip(*seen))
            columns = [pa.array(k, pa.string()) for k in keys] + [pa.array(list(seen.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "votes", "features", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, votes string, features string, n long")
    return rows.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


def label_model(votes: list[str], n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior that a candidate is personal data, for each vote pattern, by expectation-maximisation.

    Each labeler has its own odds of voting + - 0 under either truth (smoothed by one vote of
    each kind); the start is the share of + among the votes cast.
    """
    x = np.array([["+-0".index(c) for c in v] for v in votes])
    p = np.array([(1 + v.count("+")) / (2 + v.count("+") + v.count("-")) for v in votes])
    hot = np.eye(3)[x]
    for _ in range(rounds):
        logs = []
        for w in (p * n, (1 - p) * n):
            odds = np.einsum("i,ijk->jk", w, hot) + 1
            odds /= odds.sum(axis=1, keepdims=True)
            logs.append(np.einsum("ijk,jk->i", hot, np.log(odds)) + np.log((w.sum() + 1) / (n.sum() + 2)))
        p = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
    return p


def span_classifier(rows: list[tuple[str, str, str, int]], steps: int = 300) -> dict[str, float]:
    """Weights by feature of a logistic regression trained on the posteriors of the label model.

    rows: ``kind, votes, features, n``. The kinds have label models of their own and share the
    classifier. No rows give no weights.
    """
    rows = sorted(rows)
    if not rows:
        return {}
    target = np.zeros(len(rows))
    n = np.array([r[3] for r in rows], float)
    for kind in KINDS:
        at = [i for i, r in enumerate(rows) if r[0] == kind]
        if at:
            target[at] = label_model([rows[i][1] for i in at], n[at])
    names = sorted({f for r in rows for f in r[2].split(",")})
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [index[f] for f in r[2].split(",")]] = 1
    w, weight = np.zeros(len(names)), n / n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - target)) + 1e-4 * w)
    return dict(zip(names, w.tolist()))


def span_finder(weights: dict[str, float]) -> Callable[[str], list[tuple[int, int, str, bool]]]:
    """A function from text to ``start, end, kind, base`` of its spans, by start and then kind."""

    def find(t: str) -> list[tuple[int, int, str, bool]]:
        out = []
        for a, z, kind, form in candidates(t):
            if form == "base":
                out.append((a, z, kind, True))
            elif form == "wide":
                features = votes_and_features(t, a, z, kind, form)[1]
                if sum(weights.get(f, 0.0) for f in features.split(",")) > 0:
                    out.append((a, z, kind, False))
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))

    return find


def train(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The span classifier of a corpus, from the counts over all its documents."""
    return span_classifier([tuple(r) for r in label_counts(docs, text_col).collect()])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: for every row an array of ``start, end, kind, base`` in code points, end exclusive.

    Null and empty texts have no spans; repeated rows stay; null ids stay; other columns are not
    read; an empty table gives no rows.
    """
    find = span_finder(train(docs, text_col))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("start", "end", "kind", "base"), s)) for s in find(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, span)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<start:int,end:int,kind:string,base:boolean>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, such as ``<EMAIL>``.

    Overlapping spans become one. All other columns, whatever their names, and texts without spans stay as they are; null and
    empty texts have no spans; repeated rows stay and are treated alike; an empty table gives no rows.
    """
    find = span_finder(train(docs, text_col))
    at = docs.columns.index(text_col)

    def clean(t: str | None) -> str | None:
        spans = find(t) if t else []
        if not spans:
            return t
        out, last = [], 0
        for a, z, kind, _ in spans:
            if a >= last:
                out += [t[last:a], f"<{kind.upper()}>"]
            last = max(last, z)
        return "".join(out) + t[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, 16 << 20):
            columns = b.columns
            columns[at] = pa.array([clean(t.as_py()) for t in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document: counts and digest of base spans, and all spans."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )
