"""Operator 2: personal data by rules, and more of it by a conditional random field over word shapes.

The rules find e-mail addresses, IP addresses, card and phone numbers. The field, trained on a small labelled table, adds
phone numbers without a country code, social security numbers and credentials; it never removes or changes a rule's span. Words with a
digit, @ or =, or that name a credential before a colon, and their neighbours form the sequences that it decodes, in numpy batches; all
other words are prose to it: what has none of these marks within three words in its line (names, street addresses in words) is not its matter.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Crf

KINDS = ("email", "ip", "card", "phone")
ADDED = ("ssn", "secret")
ORDER = {k: i for i, k in enumerate((*KINDS, *ADDED))}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@=]")
#: A credential's name and a colon: a trigger without digits.
NAMED = re.compile(r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key)[\"']?:")
WORD = re.compile(r"[^ \t-\r]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from each @ outwards: in time linear in the text, whatever its runs."""
    done, k = 0, text.find("@")
    while k >= 0:
        a = k
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, k + 1) if a < k else None
        if m:
            done = m.end()
            yield a, done
        k = text.find("@", max(k + 1, done))


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans (kind, start, end), by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


LABELS = ("O", "B-phone", "I-phone", "B-ssn", "B-secret", "I-secret")
#: Words that announce what follows; the place in the list is the feature.
CUES = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "ssn", "social", "security", "phone", "tel", "call", "mobile", "id", "no", "page", "version", "order", "passphrase", "api_key", "api-key", "commit", "revision", "checksum", "digest", "hash", "md5", "sha1", "sha256")
EDGE = "\"'`,;:!?<>[]{}#*|~^%&"
#: Feature slots of a word, and ids of each; words before it in which a cue counts.
SLOTS, BUCKET, LOOK_BACK = 10, 512, 4


def shape(word: str) -> str:
    """Runs of upper case, lower case and digits as X, x and d with the digits' number up to 9; other characters as they are."""
    out = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 9)}", word)
    out = re.sub(r"[^\W\d_]+", lambda m: m[0] if re.fullmatch("d", m[0]) and out[m.end() : m.end() + 1].isdigit() else ("X" if m[0].isupper() else "x" if m[0].islower() else "Xx"), out)
    return out[:24]


def features(words: list[str]) -> np.ndarray:
    """Feature ids of each word, one per slot."""
    bare = [w.strip(EDGE) for w in words]
    bare = [w[:-1] if w.endswith(".") else w for w in bare]
    forms = [crc32(shape(w).encode()) % (BUCKET - 1) + 1 for w in bare]
    rows = []
    cued = [CUES.index(x) + 1 if (x := w.lower().rstrip(":=")) in CUES else 0 for w in bare]
    for i, w in enumerate(bare):
        head = re.split("[=:]", w.lower(), maxsplit=1)[0]
        cue = CUES.index(head) + 1 if head in CUES else 0
        digits, letters = sum(c.isdigit() for c in w), sum(c.isalpha() for c in w)
        mixed = (digits > 0) + 2 * (letters > 0) + 4 * (w.isupper()) + 8 * ("=" in w) + 16 * ("@" in w or "://" in w or "/" in w) + 32 * bool(re.fullmatch("[0-9a-f]+", w))
        rows.append((forms[i], forms[i - 1] if i else 0, forms[i + 1] if i + 1 < len(bare) else 0, min(len(w), 40), min(digits, 25), cue, cued[i - 1] if i else 0, mixed, min(40, len(set(w))), next((c for c in reversed(cued[max(0, i - LOOK_BACK) : i]) if c), 0)))
    return np.array(rows, np.int64).reshape(-1, SLOTS) + np.arange(SLOTS) * BUCKET


def labelled(rows: int = 1400, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences with private words of each kind, and as many with harmless numbers, made by rule."""
    r = random.Random(seed)
    pick = lambda abc, n: "".join(r.choice(abc) for _ in range(n))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

    def prose(n: int, most: int = 12) -> list[tuple[str, str]]:
        return [(w.capitalize() if r.random() < 0.15 else w + r.choice(("", "", "", ",", ".")), "O") for w in (pick(low, r.randint(1, most)) for _ in range(n))]

    def private() -> list[tuple[str, str]]:
        k = r.randrange(9)
        if k == 8:
            word = pick(low, r.randint(9, 20)) if r.random() < 0.6 else pick(low + up, r.randint(8, 20))
            return [(r.choice(("password", "Password", "passwd", "passphrase", "pwd", "secret", "token", "api_key")) + ":", "O"), (word, "B-secret")]
        if k == 0:
            return [(f"({r.randint(200, 999)})", "B-phone"), (f"{pick(num, 3)}-{pick(num, 4)}", "I-phone")]
        if k == 1:
            sep = r.choice("-.")
            return [(sep.join((pick(num, 3), pick(num, 3), pick(num, 4))), "B-phone")]
        if k == 2:
            return [(f"{pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}", "B-ssn")]
        if k == 3:
            return [(f"{r.choice(('password', 'passwd', 'pwd', 'secret', 'token', 'api_key'))}{r.choice('=:')}{pick(r.choice((hexa, low + num + up)), r.randint(8, 32))}", "B-secret")]
        if k == 4:
            return [(f"{r.choice(('AKIA', 'ASIA', 'AGPA'))}{pick(up + num, 16)}", "B-secret")]
        if k == 5:
            q = r.choice(('"', "'", ""))
            return [(r.choice(("token", "key", "secret", "apikey")), "O"), *([("=", "O")] * r.randint(0, 1)), (q + pick(hexa, r.choice((32, 40, 40, 64))) + q, "B-secret")]
        if k == 6:
            return [(r.choice(("sk", "ghp", "pk", "xoxb")) + r.choice("-_") + pick(low + num + up, r.randint(20, 40)), "B-secret")]
        return [('"' + pick(hexa, 40) + '"', "B-secret")]

    def harmless() -> list[tuple[str, str]]:
        k = r.randrange(18)
        if k >= 16:
            return [(r.choice(("password", "secret", "token", "passphrase")) + ":", "O"), *prose(r.randint(1, 3), 6)]
        if k >= 14:  # commits and checksums
            n = r.choice((32, 40, 40, 64, 64))
            name = r.choice((["commit"], ["revision"], ["hash", "is"], ["md5"], ["sha1"], ["sha256"], ["sha256", "of", "file", "is"], ["checksum", "of", pick(low, 6)], ["digest", "of", "the", pick(low, 5)], []))
            colon = ":" if len(name) == 1 and r.random() < 0.3 else ""
            return [*((w + colon, "O") for w in name), (pick(hexa, n), "O"), *([(f"{pick(low, 5)}.{pick(low, 3)}", "O")] if not name else [])]
        w = (
            lambda: str(r.randint(0, 9999)), lambda: str(r.randint(1900, 2100)), lambda: f"{r.randint(1, 999)}.{pick(num, r.randint(1, 3))}", lambda: f"{r.randint(1, 99)},{pick(num, 3)}",
            lambda: f"{r.randint(2000, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", lambda: f"{r.randint(0, 23)}:{pick('012345', 1)}{pick(num, 1)}",
            lambda: f"{pick(low, 5)}.{pick(num, 2)}@{pick(low, 4)}{pick(num, 1)}.example.com", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: pick("456", 1) + pick(num, 15),
            lambda: f"https://{pick(low, 6)}.example.com/{pick(low, 4)}/{r.randint(1, 9999)}?page={r.randint(1, 9)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: f"{pick(low, r.randint(2, 8))}{r.randint(0, 99)}", lambda: f"{pick(low, 1)}={r.randint(0, 99)}",
        )[k]()
        if r.random() < 0.12:
            return [("+1", "O"), (f"({pick(num, 3)})", "O"), (f"555-{pick(num, 4)}", "O")]  # with its country code: the rules have it
        return [(w + r.choice(("", "", ".", ",")), "O")]

    out = []
    for i in range(rows):
        s = prose(r.randint(0, 4)) + (private() if i % 2 else harmless()) + prose(r.randint(0, 4)) + (harmless() if r.random() < 0.3 else [])
        out.append(([w for w, _ in s], [y for _, y in s]))
    return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in rows])
    out = np.zeros((len(rows), int(length.max()), SLOTS), np.int64) + np.arange(SLOTS) * BUCKET
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out, length


def train(table: list[tuple[list[str], list[str]]] | None = None) -> Crf:
    """The field, from a table of words and labels; the same on every run."""
    table = labelled() if table is None else table
    x, length = padded([features(w) for w, _ in table])
    y = np.zeros(x.shape[:2], np.int64)
    for i, (_, labels) in enumerate(table):
        y[i, : len(labels)] = [LABELS.index(k) for k in labels]
    return Crf(SLOTS * BUCKET, len(LABELS)).fit(x, y, length)


@cache
def trained() -> Crf:
    """The field of the labelled table, trained once in a driver."""
    return train()


#: Words around a trigger that go with it, and the longest sequence; longer runs of triggers are decoded in pieces.
AROUND, LONGEST = 3, 64
#: Words at a cut that two pieces share; each piece tells the labels of its half of them, so a word has as many neighbours at least as half of these.
SHARED = 4 * AROUND


def sequences(text: str) -> Iterator[list[tuple[str, int]]]:
    """Words (with their places) around those with a trigger, neighbouring ones together. Only lines with a trigger are split."""
    hot = [m.start() for m in TRIGGER.finditer(text)]
    if ":" in text and (named := [m.start() for m in NAMED.finditer(text)]):
        hot = sorted(hot + named)
    if not hot:
        return
    at, n = 0, len(text)
    while at < len(hot):
        a = text.rfind("\n", 0, hot[at]) + 1
        b = text.find("\n", hot[at])
        b = n if b < 0 else b
        words = [(m[0], m.start() + a) for m in WORD.finditer(text[a:b])]
        marked = np.array([bool(TRIGGER.search(w) or NAMED.search(w)) for w, _ in words])
        near = np.convolve(marked, np.ones(2 * AROUND + 1), "same") > 0 if len(words) > 2 * AROUND else np.ones(len(words), bool)
        run: list[tuple[str, int]] = []
        for w, keep in zip(words, near, strict=True):
            if keep:
                run.append(w)
            if run and not keep:
                yield run
                run = []
        if run:
            yield run
        while at < len(hot) and hot[at] < b + 1:
            at += 1


def pieces(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first, last) of the pieces of a run of n words; the labels from first to last, which follow on each other, are the piece's to tell."""
    lo, first = 0, 0
    while n - lo > LONGEST:
        yield lo, lo + LONGEST, first, lo + LONGEST - SHARED // 2
        first, lo = lo + LONGEST - SHARED // 2, lo + LONGEST - SHARED
    yield lo, n, first, n


def added_spans(field: Crf, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the field adds to each text's spans: decoded together, 512 sequences a batch; spans that touch a rule's are left out."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    runs = [(i, s) for i, t in enumerate(texts) for s in sequences(t)]
    told = [np.zeros(len(s), np.int64) for _, s in runs]
    work = [(r, *p) for r, (_, s) in enumerate(runs) for p in pieces(len(s))]
    work.sort(key=lambda w: w[2] - w[1])
    for at in range(0, len(work), 512):
        part = work[at : at + 512]
        x, length = padded([features([w for w, _ in runs[r][1][lo:hi]]) for r, lo, hi, _, _ in part])
        for (r, lo, _, first, last), y in zip(part, field.decode(x, length), strict=True):
            told[r][first:last] = y[first - lo : last - lo]
    for (i, s), y in zip(runs, told, strict=True):
        k = 0
        while k < len(s):
            name = LABELS[y[k]]
            e = k + 1
            if name != "O":
                while e < len(s) and LABELS[y[e]] == f"I-{name[2:]}":
                    e += 1
                first, last = s[k][0], s[e - 1][0]
                a = s[k][1] + len(first) - len(first.lstrip(EDGE))
                b = s[e - 1][1] + len(last.rstrip(EDGE + "."))
                if b > a and all(b <= p or a >= q for _, p, q in base[i]):
                    out[i].append((name[2:], a, b))
            k = e
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ORDER[s[0]], s[1], s[2])))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", field: Crf | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (the rules' spans), base_sha256 (of these spans, joined), spans (all, joined), n_spans (their number) and text_key (a hash of the text, for redact()).

    Null and empty texts have no spans; each row stands by itself, repeated ones alike; no shuffle; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or trained())
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, text_key long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(held.value, texts, base)
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            digest = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
            every = [x + y for x, y in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest), pa.array([joined(x) for x in every]), pa.array([len(x) for x in every], pa.int64()), b.column(2)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(run, schema)


def redact(texts: DataFrame, spans: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of texts: doc_id and the text with each span of find() replaced by its kind in brackets.

    A row's spans are those of its doc_id and text, so null and repeated ids keep their rows and spans; rows that spans
    lacks pass as they are; null texts stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                end = None
                for kind, a, e in sorted(((k, int(a), int(e)) for k, a, e in (x.split(":") for x in (s or "").split(",") if x)), key=lambda x: -x[1]):
                    if t is not None and (end is None or e <= end):
                        t, end = f"{t[:a]}[{kind}]{t[e:]}", a
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    t = texts.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    s = spans.where("n_spans > 0").select(F.col("doc_id").alias("d"), "text_key", "spans").dropDuplicates(["d", "text_key"])
    return t.join(s, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("text_key")), "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")
