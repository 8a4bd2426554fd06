"""The training-data operators: defined results on awkward rows, and agreement with brute force."""

import collections
import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lamella.llm import bpe, chat, crf, decontam, id_shards, lpf, mixing, mph, near_dup, pii, quality, shingles, suffix_dedup, token_counts, warc
from lamella.llm.common import fresh_dir, opened, stored
from lamella.llm.components import components
from lamella.llm.zipread import ZipRanges

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


LONG = prose(20_000, 1)
SHARED = prose(120, 2)
EDITED = " ".join("zz" if k == 60 else w for k, w in enumerate(SHARED.split()))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank and very long texts, exact and near copies, a repeated row, clashing extra columns."""
    texts = [None, "", " \n\t ", LONG, SHARED, SHARED, EDITED, SHARED.upper(), "one two", "One  two", prose(90, 3) + " " + SHARED, "mail a.b@c.example.com or 10.0.0.1"]
    rows = [(i, t, "en", "src0" if i % 3 else "src1", None) for i, t in enumerate(texts)]
    rows += [(4, SHARED, "en", "src0", 1), (None, SHARED, None, None, None), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit(7) for c in ("h", "d", "x", "v", "set", "n", "kept", "n_tokens", "key", "llr", "mix_copy", "component_id", "__h")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1: suffix-array dedup


def brute_removals(rows, length):
    texts = [t.encode() for _, t in rows]
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(df, **more):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.removals(df, **more).collect()), key=str)


def test_removals_of_odd_rows(odd, none):
    assert removed(odd) == brute_removals(plain(odd), 400)
    assert removed(none) == []


def test_removals_by_blocks_and_by_hashes(spark, monkeypatch):
    r = random.Random(5)
    bits = [prose(30, k) for k in range(4)]
    rows = [(i, " ".join(r.choice(bits) if r.random() < 0.6 else prose(r.randint(1, 12), r.random()) for _ in range(r.randint(0, 5)))) for i in range(60)] + [(98, "ab" * 300), (99, "ä" * 200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removals(rows, 60)
    assert removed(d, length=60, part=30) == want
    monkeypatch.setattr(suffix_dedup, "MAX_SPANS", 2)  # nearly all groups go by hashes
    assert removed(d, length=60, part=30) == want


@pytest.mark.parametrize("copies", [100, 400])
def test_repeated_rows_are_folded(spark, copies):
    """However many rows have one text, with or without ids, its anchors are kept once a task at most, and the copies' fate is known without comparing them."""
    text, other = prose(400, 31), prose(30, 32) + prose(400, 31)[200:1200]
    rows = [(None if k % 2 else k, text) for k in range(copies)] + [(10**6, other)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = suffix_dedup.anchor_rows(d.withColumn("t", suffix_dedup.identity()), 400, 200)
    assert marks.count() <= 5 * marks.select("t", "place").distinct().count()
    assert removed(d) == brute_removals(rows, 400)


def test_large_groups_are_cut_twice(spark, monkeypatch):
    """A string in more contexts than a block holds, some of them the same up to a few bytes."""
    r = random.Random(8)
    core = prose(60, 41)
    rows = [(i, prose(r.randint(0, 3), 50 + i % 5) + core[r.randint(0, 40) : len(core) - r.randint(0, 40)] + prose(r.randint(0, 3), 60 + i % 7)) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removals(rows, 120)
    for most in (1, 4):
        monkeypatch.setattr(suffix_dedup, "MAX_SPANS", most)
        assert removed(d, length=120, part=60) == want


def test_shorter_passages_are_told(spark):
    """Texts that share a string of 40 bytes are told, whatever is removed for strings of 120."""
    r = random.Random(12)
    bits = [prose(9, k) for k in range(12)]
    rows = [(i, " ".join(r.choice(bits) if r.random() < 0.25 else prose(r.randint(1, 9), r.random()) for _ in range(r.randint(0, 6)))) for i in range(90)]
    rows += [(95, prose(30, 81) + "x"), (96, "y" + prose(30, 81)), (97, "ab" * 20), (98, prose(8, 82)), (99, prose(8, 82)), (100, prose(4, 83)), (101, prose(4, 83))]
    seen = collections.Counter(b[i : i + 40] for _, t in rows for b in [t.encode()] for i in range(len(b) - 39))
    want = {i: any(seen[t.encode()[k : k + 40]] > 1 for k in range(len(t.encode()) - 39)) for i, t in rows}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.removals(d, length=120, part=60, passage=40).collect()
    assert {r["doc_id"]: r["has_repeats"] for r in out} == want and 20 < sum(want.values()) < 80
    assert removed(d, length=120, part=60) == brute_removals(rows, 120)


def test_keep_first(spark):
    a = prose(150, 9)
    d = spark.createDataFrame([(1, prose(20, 1) + a), (2, prose(30, 2) + a), (3, a)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.removals(d, keep_first=True).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] >= len(a) and got[3]["kept_text"] == b""


def test_longest_previous_factors():
    r = random.Random(1)
    for _ in range(150):
        t = bytes(r.choice(b"ab") for _ in range(r.randint(0, 100)))
        n = r.choice([8, 11, 16, 40])
        d, at = np.frombuffer(t, np.uint8), np.arange(max(0, len(t) - n + 1))
        pos, length, source = lpf.previous_factors(d, at, n)
        _, early, late = lpf.repeated(d, at, n)
        for i in pos:
            assert (length[i] >= n) == early[i] == any(t[j : j + n] == t[i : i + n] for j in range(i))
            assert late[i] == any(t[j : j + n] == t[i : i + n] for j in range(i + 1, len(at)))
            assert length[i] < n or (source[i] < i and t[source[i] : source[i] + n] == t[i : i + n])


# 2: personal data


def test_base_spans_are_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    r = random.Random(2)
    for _ in range(4000):
        t = "".join(r.choice("aB1.@-+ 2%3()9") for _ in range(r.randint(0, 40)))
        want = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
        assert pii.base_spans(t) == want
    assert [k for k, *_ in pii.base_spans("4111 1111-1111 1111, 4111111111111112, 256.1.1.1, 1.2.3.4")] == ["ip", "card"]


def test_field_on_held_out_rows():
    field = pii.train()
    held = pii.labelled(300, seed=123)
    x, length = pii.padded([pii.features(w) for w, _ in held])
    y = field.decode(x, length)
    right = sum(pii.LABELS[y[i, k]] == q for i, (_, labels) in enumerate(held) for k, q in enumerate(labels))
    assert right / sum(len(w) for w, _ in held) > 0.97


def test_viterbi_is_the_best_path():
    g = np.random.default_rng(3)
    c = crf.Crf(6, 3)
    c.w, c.t, c.s = g.normal(size=(6, 3)), g.normal(size=(3, 3)), g.normal(size=3)
    x = g.integers(0, 6, (1, 4, 2))
    e = c.emissions(x)[0]
    paths = np.stack(np.meshgrid(*[range(3)] * 4, indexing="ij"), -1).reshape(-1, 4)
    score = [c.s[p[0]] + e[0, p[0]] + sum(c.t[p[k - 1], p[k]] + e[k, p[k]] for k in range(1, 4)) for p in paths]
    assert (c.decode(x, np.array([4]))[0] == paths[int(np.argmax(score))]).all()


def test_long_runs_are_cut_without_loss():
    for n in (1, 64, 65, 116, 117, 1000):
        cuts = list(pii.pieces(n))
        assert [k for _, _, a, b in cuts for k in range(a, b)] == list(range(n)) and all(lo <= a < b <= hi and hi - lo <= pii.LONGEST for lo, hi, a, b in cuts)
    field = pii.train()
    for k in range(50, 72):
        text = " ".join([*["12"] * k, "(555)", "123-4567", *["34"] * 80])
        at = text.index("(")
        assert ("phone", at, at + 14) in pii.added_spans(field, [text], [[]])[0], k


def test_pii_of_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in pii.find(odd).collect()}
    assert rows[11]["n_email"] == 1 and rows[11]["n_ip"] == 1 and rows[11]["spans"].startswith("email:5:22,ip:26:34")
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3]["spans"] == ""
    assert pii.find(odd).count() == odd.count() and pii.find(none).count() == 0
    text = pii.redact(odd.where("doc_id = 11"), pii.find(odd)).first()["text"]
    assert text == "mail [email] or [ip]"


def test_credentials_and_checksums():
    field = pii.train()
    find = lambda t: [(k, t[a:b]) for k, a, b in pii.added_spans(field, [t], [pii.base_spans(t)])[0]]
    h = "24bed1b2c3d4e5f60718293a4b5c6d7e8f901234"
    for t in (f"commit {h} merged", f"sha256 of file is {h}{h[:24]}", "the secret: he went home", "2023-10-11 and version 1.2.3", "order no 4839201 page 12", "no mark at all"):
        assert find(t) == [], t
    assert find("password: hunterpassphrase") == [("secret", "hunterpassphrase")]
    assert find(f'key = "{h}"###') == [("secret", h)] and find(f'x token = "{h}" y') == [("secret", h)]


def test_planted_secrets(spark):
    """Recall and precision of the added spans on real rows: documents hold tokens of one form."""
    rows = [t for _, t in plain(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))]
    got = pii.added_spans(pii.train(), rows, [pii.base_spans(t) for t in rows])
    want = [{m.span(1) for m in re.finditer('(?i)token = "([0-9a-f]{40})"', t)} for t in rows]
    mine = [{(a, b) for _, a, b in g} for g in got]
    hit, all_, told = (sum(map(len, x)) for x in ([m & w for m, w in zip(mine, want, strict=True)], want, mine))
    assert all_ > 5 and hit >= 0.95 * all_ and hit >= 0.95 * told


def test_redaction_keeps_rows(spark):
    rows = [(1, "mail a@b.example.com"), (1, "call +1 555 000 1111 now"), (None, "at 10.0.0.1"), (None, "at 10.0.0.1"), (None, None), (2, "nothing")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in pii.redact(d, pii.find(d)).collect()), key=str)
    assert got == sorted([(1, "mail [email]"), (1, "call [phone] now"), (None, "at [ip]"), (None, "at [ip]"), (None, None), (2, "nothing")], key=str)


# 3: token counts


def test_token_counts(odd, none):
    tok = Tokenizer.from_file(BPE)
    d = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(50), "text": F.lit("a<|endoftext|>b  \n  c　漢字 I'm 12²")}))
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(d, BPE).collect()}
    for i, t in plain(d):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert got[i, len(t.encode())] == (n, n > 1024)
    assert token_counts.count_tokens(none, BPE).count() == 0


def test_encoder_forgets_and_stays_right():
    source = bpe.read_tokenizer(BPE)
    e = bpe.Encoder(source, bpe.base_table(source), list, room=50_000)
    r = random.Random(4)
    letters = [chr(c) for c in (*range(0x250), 0x2019, 0x3042, 0x1F600)]
    for _ in range(1500):
        t = "".join(r.choice(letters if r.random() < 0.5 else " \n'abS1.é") for _ in range(r.randint(0, 30)))
        assert [i for v in e.values_of(t) for i in v] == e.tok.encode(t, add_special_tokens=False).ids
    assert len(e) <= 50_001


def test_every_character_is_split_as_the_library_does():
    e = bpe.Encoder(bpe.read_tokenizer(BPE), {}, list)
    sure = [c for k in range(0x110000) if not bpe.unsure().match(c := chr(k))]
    assert len(sure) > 1_060_000
    for k in range(0, len(sure), 500):
        t = "".join(f"a{c} {c}1{c}{c} " for c in sure[k : k + 500])
        assert [i for v in e.values_of(t) for i in v] == e.tok.encode(t, add_special_tokens=False).ids
    for t in ("Привет, мир 12", "漢字かな交じり文。 100€ 😀😀 naïve", "\u180ea \x1c b", "नमस्ते दुनिया ١٢٣", "𝒳𝟙 \u3000x"):
        assert [i for v in e.values_of(t) for i in v] == e.tok.encode(t, add_special_tokens=False).ids


def test_frequent_pre_tokens(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = dict(bpe.frequent(d, "text", bpe.read_tokenizer(BPE)).items())
    tok = Tokenizer.from_file(BPE)
    assert 0 < len(table) <= bpe.MAX_FREQUENT and any(len(v) > 1 for v in table.values())
    assert all(tok.encode(k, add_special_tokens=False).ids == v for k, v in list(table.items())[:3000])
    pieces = [p for _, t in plain(d) for p in bpe.pre_tokens(t)]
    assert sum(p in table for p in pieces) > 0.9 * len(pieces)
    assert list(bpe.frequent(d.limit(0), "text", bpe.read_tokenizer(BPE)).items()) == []


# 4: decontamination

ITEMS = [prose(40, 100 + k) for k in range(3)] + ["seven short words make one small item", "too short"]


def test_contamination(spark, odd, none):
    bench = spark.createDataFrame(list(enumerate(ITEMS)) + [(9, None)], "item_id long, text string")
    w = ITEMS[1].split()
    w[7], w[20] = "other", "words"
    rows = [(1, prose(50, 7) + " " + ITEMS[0].upper().replace(" ", ", ") + " " + prose(9, 8)), (2, " ".join(w)), (3, prose(300, 9)), (4, None), (5, ""), (6, "x " + ITEMS[3] + "."), (7, " ".join(ITEMS[2].split()[5:30])), (8, "too short")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["length"], r["n_equal"]) for r in decontam.contamination(d, bench).collect()}
    assert got == {(1, 0): (50, 40, 40), (2, 1): (0, 40, 38), (6, 3): (1, 7, 7), (7, 2): (0, 25, 25)}
    assert sorted(r["doc_id"] for r in decontam.clean(d, bench).collect()) == [3, 4, 5, 8]
    assert decontam.contamination(none, bench).count() == decontam.contamination(d, bench.limit(0)).count() == 0
    assert decontam.clean(odd, bench).count() == odd.count()


def test_benchmarks_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    d = spark.createDataFrame([(k, t) for k, t in enumerate(ITEMS)], "doc_id long, text string")
    one = sorted(map(tuple, decontam.contamination(d, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert len(decontam.blocks(bench, "item_id", "text")) > 2 and sorted(map(tuple, decontam.contamination(d, bench).collect())) == one


def test_benchmarks_by_join(spark, monkeypatch, odd):
    """The join of seeds finds what blocks find, rows and items that repeat included, and the same documents go."""
    bench = spark.createDataFrame([*enumerate(ITEMS), (1, ITEMS[1]), (9, None), (8, "")], "item_id long, text string")
    w = ITEMS[1].split()
    w[7], w[20] = "other", "words"
    rows = [(k, t) for k, t in enumerate(ITEMS)] + [(None, " ".join(w)), (None, " ".join(w)), (20, ITEMS[0] + " " + LONG + " " + ITEMS[2]), (21, None), (22, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, decontam.contamination(d, bench).collect()), key=str)
    kept = sorted((tuple(r) for r in decontam.clean(odd.select("doc_id", "text").unionByName(d), bench).collect()), key=str)
    assert len(one) >= 10
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 50)
    monkeypatch.setattr(decontam, "MAX_BLOCKS", 1)
    assert sorted(map(tuple, decontam.contamination(d, bench).collect()), key=str) == one
    assert sorted((tuple(r) for r in decontam.clean(odd.select("doc_id", "text").unionByName(d), bench).collect()), key=str) == kept
    assert decontam.contamination(d.limit(0), bench).count() == 0


def brute_stretch(same):
    """(equal, -length, -start) of the best stretch with four in five equal, by trying all."""
    n = len(same)
    e = np.concatenate([[0], np.cumsum(same)])
    return max(((int(e[y] - e[x]), x - y, -x) for x in range(n) for y in range(x + 1, n + 1) if 5 * (e[y] - e[x]) >= 4 * (y - x) and same[x] and same[y - 1]), default=(0, 0, 0))


def test_stretches():
    r = np.random.default_rng(5)
    for n in (0, 1, 5, 12, 30, 45):
        for share in (0, 0.1, 0.2, 0.25, 0.5, 1):
            same = r.random(n) >= share
            x, y = decontam.stretch(same)
            assert (int(same[x:y].sum()), x - y, -x if y else 0) == brute_stretch(same)


def test_substituted_items(spark):
    """Items with 10 to 20 % of their tokens substituted, at even steps and at random, against every stretch of every alignment."""
    r = random.Random(4)
    items = [prose(n, 200 + n) for n in (15, 20, 25, 30, 40, 55)]
    docs = []
    for t in items:
        w = t.split()
        for lost in [range(4, len(w), 5), range(9, len(w), 10), *(r.sample(range(len(w)), len(w) * p // 100) for p in (10, 15, 20) for _ in range(3))]:
            v = [f"new{k}" if k in set(lost) else x for k, x in enumerate(w)]
            docs.append(" ".join([*prose(r.randint(0, 9), len(docs)).split(), *v, *prose(r.randint(0, 9), 1000 + len(docs)).split()]))
    want = set()
    for i, d in enumerate(docs):
        a = np.array(d.split())
        for k, t in enumerate(items):
            b = np.array(t.split())
            best = (0, 0, 0)
            for shift in range(1 - len(b), len(a)):
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                equal, length, start = brute_stretch(a[lo:hi] == b[lo - shift : hi - shift])
                best = max(best, (equal, length, start - lo))
            if best[0] >= 10:
                want.add((i, k, -best[2], -best[1], best[0]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["length"], r["n_equal"]) for r in decontam.contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}
    assert len(want) == len(docs) and got == want


# 5: quality rules


def test_base_rules(spark, odd):
    texts = ["a b c a b c d", "x\nx\n \nx y\n# | <b> $", " ".join(["w"] * 60), "  é\x1c", *[t for _, t in plain(odd)][:9]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.judge(d, [0] * 16).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k in range(len(w) - 2) for j in range(3) if tri[w[k], w[k + 1], w[k + 2]] > 1}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 2 * len(cover) > len(w)) and r["kept"] == (not r["base_failed"])


def test_ratio_is_brute_forces(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    n = 1 << 10
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}

    def grams(t):
        h = [xxhash.xxh64_intdigest(w, seed=42) for w in WORD.findall(t)]
        pair = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)) for a, b in zip(h, h[1:], strict=False)]
        return [(x - (1 << 64) * (x >> 63)) % n for x in h + pair]

    raw, mine = collections.Counter(), collections.Counter()
    all_grams = {i: grams(t) for i, t in plain(docs)}
    for i, g in all_grams.items():
        raw.update(g)
        if i in good:
            mine.update(g)
    want = [10_000 * (np.log((mine[b] + 1) / (mine.total() + n)) - np.log((raw[b] + 1) / (raw.total() + n))) for b in range(n)]
    got = quality.fit(docs, labels, buckets=n)
    assert np.abs(np.array(got) - want).max() <= 0.51
    scores = {r["doc_id"]: r["llr"] for r in quality.judge(docs, got).collect()}
    for i, g in all_grams.items():
        assert abs(scores[i] - sum(got[b] for b in g) / len(g) / 10_000) < 1e-9


def test_quality_without_rows_or_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.rate(none, labels).count() == 0
    r = quality.rate(odd, labels)
    assert r.count() == odd.count() and r.where("kept").count() == r.where("not base_failed").count() and r.where("h = 7 and v = 7").count() == odd.count()


def test_threshold_between_good_and_bad():
    clean = [k / 1000 for k in range(300)]
    assert quality.threshold_between(clean, [-1.0, -0.2, 0.001, 0.2]) == pytest.approx((0.001 + 0.003) / 2)
    assert quality.threshold_between(clean[:99], [-1.0, -0.2]) == -0.1 and quality.threshold_between(clean, []) == 0.003
    assert quality.threshold_between([], [-1.0]) == quality.THRESHOLD


def test_bad_documents_go(spark):
    """The threshold follows from labels of even ids; labelled rows of odd ids, which it has not seen, are told apart by it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    even, odd_ids = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    parts, good = quality.fit_parts(docs, even, text="text", key="doc_id", buckets=1 << 12, max_trusted=10**6)
    assert parts[0] == quality.fit(docs, even, buckets=1 << 12)
    rest = even.join(good.where(quality.part_of("doc_id") == 3), "doc_id", "left_anti")
    assert parts[3] == quality.fit(docs, rest, buckets=1 << 12) != parts[0]
    rows = quality.rate(docs, even).where("not base_failed").join(odd_ids, "doc_id")
    n = {(r["bad"], r["kept"]): r["n"] for r in rows.groupBy((F.col("quality") == 0).alias("bad"), "kept").agg(F.count("*").alias("n")).collect()}
    assert n[True, True] <= 2 and n[True, False] >= 15 and (False, False) not in n


def brute_threshold(docs, labels):
    """The threshold by lists: every labelled row that passes the rules, each scored without its part."""
    parts, good = quality.fit_parts(docs, labels, text="text", key="doc_id", buckets=quality.BUCKETS)
    part = {r["doc_id"]: r["p"] for r in good.select("doc_id", quality.part_of("doc_id").alias("p")).collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()} - set(part)
    scores = [{r["doc_id"]: r["llr"] for r in quality.judge(docs, p).where("not base_failed").collect()} for p in parts]
    return quality.threshold_between([scores[p][i] for i, p in part.items() if i in scores[0]], [scores[0][i] for i in bad if i in scores[0]])


def two_wordings(spark):
    """6,000 trusted rows, of which the last 1,000 by hash are worded like 2,000 without a label; their ids, the documents and labels."""
    ids = sorted(range(6000), key=lambda i: (lambda x: x - (1 << 64) * (x >> 63))(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=42)))
    rng = random.Random(5)
    text = lambda c: " ".join(f"{c}{rng.randrange(200)}" for _ in range(60))
    rows = [(i, text("a" if k < 5000 else "b")) for k, i in enumerate(ids)] + [(i, text("b")) for i in range(6000, 8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    return ids, docs, labels


def test_threshold_takes_every_label(spark):
    """99 % of all trusted rows stay, not of the first 5,000."""
    ids, docs, labels = two_wordings(spark)
    got = {r["doc_id"]: r["kept"] for r in quality.rate(docs, labels).collect()}
    assert len(got) == 8000 and sum(got[i] for i in ids) >= 0.99 * 6000
    assert got == {r["doc_id"]: r["kept"] for r in quality.rate(docs, labels, threshold=brute_threshold(docs, labels)).collect()}


def test_model_takes_every_label(spark):
    """A model of 20,001 trusted rows has the grams of the last by hash."""
    last = max(range(20_001), key=lambda i: (lambda x: x - (1 << 64) * (x >> 63))(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=42)))
    docs = spark.range(20_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == last, "rare").otherwise("usual").alias("text"))
    ratios = quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")), buckets=1 << 12)
    assert set(ratios) == {0}


def test_rank_is_exact(spark):
    rng = random.Random(6)
    for xs in ([0.5], [-1.0, -1.0, 2.0], [rng.choice([-0.25, 0.1, 0.1 + 1e-16, 0.3]) for _ in range(50)], [rng.gauss(0, 1) for _ in range(500)], [1e6, *(rng.random() * 1e-9 for _ in range(100))]):
        rows = spark.createDataFrame([(x,) for x in xs], "x double")
        for k in {0, len(xs) // 100, len(xs) // 2, len(xs) - 1}:
            assert quality.at_rank(rows, "x", k) == sorted(xs)[k]


@pytest.mark.parametrize("key_type", ["long", "string"])
def test_labels_meet_documents(spark, monkeypatch, key_type):
    """Each row gets its label's part, by bits that are sent and by a join, whatever the ids; repeated and contradictory labels count once, the trusted one first."""
    ids = [-(2**63), -65, -64, -1, 0, 1, 63, 64, 127, 128, 2**63 - 1, None]
    rows = [(i, int(k % 3 != 0), int(k % 5 == 0)) for k, i in enumerate(ids)] + [(0, 0, 0), (0, 1, None), (5, 1, 0), (64, None, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, 1) for i in [*ids, 0, 7]], "doc_id long, __w int").withColumn("doc_id", F.col("doc_id").cast(key_type))
    labels = labels.withColumn("doc_id", F.col("doc_id").cast(key_type))
    good = {i for i, q, t in rows if i is not None and q == 1 and not t}
    bad = {i for i, q, t in rows if i is not None and q == 0} - good
    want = sorted((str(i), "good" if i in good else "bad" if i in bad else "none") for i in [*ids, 0, 7])
    for sent in (1 << 20, 0):
        monkeypatch.setattr(quality, "MAX_SENT", sent)
        out = quality.with_parts(docs, quality.label_keys(labels, "doc_id"), key="doc_id", part="p")
        got = out.withColumn("own", quality.part_of("doc_id")).collect()
        assert out.columns == ["doc_id", "__w", "p"] and all(r["p"] in (None, 0, r["own"]) for r in got)
        assert sorted((str(r["doc_id"]), "none" if r["p"] is None else "good" if r["p"] else "bad") for r in got) == want


def test_rate_carries_columns(spark, odd, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert quality.rate(odd, labels, carry=["h"]).columns == ["h", *quality.JUDGED]
    assert quality.rate(odd, labels, threshold=0.0, carry=["h"]).columns == ["h", *quality.JUDGED]
    assert quality.rate(odd, labels).columns == [*(c for c in odd.columns if c not in quality.JUDGED), *quality.JUDGED]


# 6: chats


def test_fold(spark):
    log = [
        ("c", "m1", 1, "message", "user", "hi"), ("c", "m2", 2, "delta", "assistant", "wro"), ("c", "m2", 3, "delta", None, "ng"), ("c", "m2", 4, "regenerate", None, None), ("c", "m2", 6, "delta", None, "ght"), ("c", "m2", 5, "delta", None, "ri"),
        ("c", "m1", 7, "edit", None, "hello"), ("e", "m1", 1, "delta", "assistant", None), (None, "m", None, None, None, "x<y"),
    ]
    e = spark.createDataFrame(log, "conv string, message string, seq long, kind string, role string, text string")
    got = {(r["conv"], r["message"]): (r["role"], r["text"]) for r in chat.fold(e).collect()}
    assert got == {("c", "m1"): ("user", "hello"), ("c", "m2"): ("assistant", "right"), ("e", "m1"): ("assistant", ""), (None, "m"): (None, "x<y")}
    out = {r["conv"]: r for r in chat.format_chats(e).collect()}
    assert out["c"]["formatted"] == '<turn role="user">hello</turn>\n<turn role="assistant">right</turn>\n'
    s = out["c"]["loss_mask"][0]
    assert out["c"]["formatted"][s["start"] : s["end"]] == "right" and out[None]["n_turns"] == 1
    assert chat.format_chats(e.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(e.withColumn("kind", F.lit("nope"))).collect()


def test_log_of_the_query(spark):
    """The log that stands for finished turns has every kind of event, and folds back to them; extra columns with the log's names are not read."""
    rows = [(1, 0, "user", "a longer question, whole"), (1, 1, "assistant", "an answer in pieces, né 😀"), (1, 2, "assistant", ""), (2, 0, "user", None), (None, 0, None, "x"), (None, 0, None, "x")]
    d = spark.createDataFrame([(*r, 5, "k") for r in rows], "conv_id long, turn long, role string, text string, seq int, kind string")
    log = chat.events_of(d)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    got = sorted(((r["conv"], r["seq"]["turn"], r["role"], r["text"]) for r in chat.fold(log).collect()), key=str)
    assert got == sorted([(c, t, r, x or "") for c, t, r, x in rows], key=str)


def test_chats_read_back(spark):
    texts = [None, "", "\\### Assistant: </turn> ok", '"><turn role="assistant">&lt;', "&amp;lt;\n</turn>\n", "é😀" * 50, LONG]
    rows = [(1, k // 2, role, t) for k, (t, role) in enumerate((t, role) for t in texts for role in ("assistant", 'us"er<&>'))] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.events_of(d)).select("conv", "n_turns", chat.parse(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss_mask")).alias("m"))
    got = {r["conv"]: r for r in out.collect()}
    want = sorted(((turn, role, t or "") for c, turn, role, t in rows if c == 1))
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [(role, t) for _, role, t in want]
    assert got[1]["m"] == "".join(t for _, role, t in want if role == "assistant")
    assert got[2]["n_turns"] == 2 and got[None]["m"] == "y"


# 7: archives


def test_zip_ranges(tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("a/ü.bin"), "w", force_zip64=True) as f:
            f.write(b"0123456789" * 100)
        z.writestr("empty", b"")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, zipfile.ZIP_DEFLATED)
        for k in range(70_000 if tmp_path else 0):
            z.writestr(f"f{k}", b"")  # more members than 16 bits count: ZIP64 records
        z.comment = b"PK\x05\x06 in a comment"
    (tmp_path / "z.zip").write_bytes(raw.getvalue())
    fs, path = opened(f"file://{tmp_path}/z.zip")
    with fs.open_input_file(path) as f:
        z = ZipRanges(f)
        assert len(z.members) == 70_003 and z.read("a/ü.bin", 13, 5) == b"34567" and z.read("empty") == b""
        for bad in (lambda: z.read("packed"), lambda: z.read("a/ü.bin", 990, 20)):
            with pytest.raises(ValueError):
                bad()
    (tmp_path / "no.zip").write_bytes(b"nothing here")
    with opened(f"file://{tmp_path}/no.zip")[0].open_input_file(f"{tmp_path}/no.zip") as f, pytest.raises(ValueError):
        ZipRanges(f)


def test_archives(spark):
    long = "<p>" + "ä" * 80 + "</p>"
    rows = [(5, "http://a", long), (3, "http://b\r\nX: y", long), (9, None, long), (3, "http://b", long), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", long), (4, "u", LONG)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, uri int")
    got = warc.pack_and_read(d).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        body = html.encode()
        refers = 3 if html == long and r["page_id"] in (5, 9, None) else None
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"], r["record_type"]) == (len(body), hashlib.sha256(body).hexdigest(), refers, "revisit" if refers else "response")
        assert r["payload"] == (None if refers else body)
    assert warc.pack_and_read(d.limit(0)).count() == 0


# 8: near duplicates


def brute_components(rows, percent=85):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(low))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)), key=lambda k: rows[k][0])
                up[b] = a
    return sorted((rows[k][0], len(sets[k]), rows[top(k)][0], rows[k][0] == rows[top(k)][0]) for k in range(len(rows)))


def near(df):
    return sorted(map(tuple, near_dup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_near_duplicates_of_odd_rows(odd, none):
    got = near(odd.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert got == sorted(brute_components([r for r in plain(odd.where("doc_id is not null").dropDuplicates(["doc_id"]))]), key=str)
    every = near(odd)
    assert len(every) == odd.count() and (None, 116, 4, False) in every and (None, 0, None, True) in every and every.count((4, 116, 4, True)) == 2
    assert near(none) == []


def test_rows_of_one_id_and_of_none(spark):
    """Unlike texts of one id have components of their own; rows without an id link like any and take the least id they reach."""
    a, b, c = prose(60, 71), prose(60, 72), prose(60, 73)
    edit = lambda t: " ".join("zz" if k == 30 else w for k, w in enumerate(t.split() + prose(30, 74).split()))
    rows = [(7, edit(a)), (7, edit(b)), (3, edit(a).replace("zz", "yy")), (None, edit(b).replace("zz", "yy")), (None, edit(c)), (None, edit(c).replace("zz", "yy")), (9, "")]
    got = near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == [(3, 3, True), (7, 3, False), (7, 7, True), (9, 9, True)]
    assert sorted((r[2], r[3]) for r in got if r[0] is None and r[2] is not None) == [(7, False)] and sum(r[0] is None and r[2] is None for r in got) == 2


def test_large_group_of_near_copies(spark):
    """Copies with a few edits each, many below the threshold to one another: all links are found through hubs and additions."""
    r = random.Random(6)
    base = prose(146, 11).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        w = list(base)
        for k in r.sample(range(146), r.choice([1, 2, 3, 3, 4])):
            w[k] = r.choice(["alpha", "beta", f"new{i}", "gamma"])
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(d) == sorted(brute_components(rows), key=str)


def test_estimates():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    m = np.stack([near_dup.minima(a), near_dup.minima(np.concatenate([a[:900], r.integers(0, 1 << 63, 100, dtype=np.uint64)]))])
    x, y = near_dup.packed(m).view(np.uint64)
    d = x ^ y
    equal = near_dup.HASHES - int(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
    assert abs((equal / near_dup.HASHES - 0.25) / 0.75 - 900 / 1100) < 0.2


def test_components(spark):
    e = [(k + 1, k) for k in range(40)] + [(100, 101), (103, 102), (102, 100)] + [(200, 200 + k) for k in range(1, 9)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 104)) and got[208] == 200


def test_word_hashes():
    texts = ["Ab c", None, "ab  C\nd", "", "éa b", "x" * 300_000]
    raw, off = shingles.texts_of(pa.array(texts))
    h, s, e, first = shingles.words(raw, off)
    spell = [bytes(raw[a:b]).lower() for a, b in zip(s, e, strict=True)]
    assert spell == [w.encode().lower() for t in texts for w in WORD.findall(t or "")] and list(np.diff(first)) == [len(WORD.findall(t or "")) for t in texts]
    assert len(set(h.tolist())) == len(set(spell))


# 9: id shards


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    m = mph.PerfectHash.from_bytes(mph.PerfectHash.build(keys).to_bytes())
    assert sorted(m.slots(keys)) == list(range(len(keys))) and len(m.bits) * 8 < 5 * len(keys)
    with pytest.raises(ValueError):
        mph.PerfectHash.build(np.array([1, 1], np.uint64))
    assert len(mph.PerfectHash.build(np.zeros(0, np.uint64)).slots(np.array([5], np.uint64))) == 1


def test_id_shards(spark, odd, none):
    tok = Tokenizer.from_file(BPE)
    shards = id_shards.write(odd, fresh_dir(spark, "test"), BPE)
    got = sorted(map(tuple, id_shards.read(spark, shards).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    rows = sorted(plain(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, want = 0, []
    for i, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    s = next(s for s in shards if s.docs)
    fs, path = opened(s.uri)
    with fs.open_input_file(path) as f:
        r = id_shards.ShardReader(f)
        k = r.keys()[0]
        assert len(r.get(None if k["null"] else int(k["id"]), int(k["nth"]))) > 0 and r.get(10**15) is None
    assert id_shards.write_and_read(none, BPE).count() == 0


def test_shards_by_bytes(spark):
    """A third of all rows without an id, and one id of many texts: spread over shards, places still those of one run of ids."""
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, prose(20 + k % 7, 900 + k)) for k in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    shards = id_shards.write(d, fresh_dir(spark, "test"), BPE, shard_bytes=4_000)
    size = sum(len(t) for _, t in rows)
    assert size / 8_000 < len(shards) <= size / 4_000 + 1 and max(s.docs for s in shards) < 60
    got = sorted(map(tuple, id_shards.read(spark, shards).select("start", "n_tokens", "doc_id").collect()))
    assert [s for s, _, _ in got] == list(np.cumsum([0] + [n for _, n, _ in got[:-1]])) and len(got) == len(rows)
    ids = [i for _, _, i in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    one = id_shards.write(d, fresh_dir(spark, "test"), BPE)
    assert len(one) == 1 and sorted(map(tuple, id_shards.read(spark, one).select("start", "n_tokens", "doc_id").collect())) == got


# 10: mixing


def test_poisson_draws_are_inversions(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 < 3, "b").alias("source"))
    out = mixing.mix(d, weights={"a": 3.0, "b": 1.0}, size=1.0)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert None not in n and abs(n["a"] - 15_000) < 600 and abs(n["b"] - 5_000) < 300
    again = mixing.mix(d.repartition(7), weights={"a": 3.0, "b": 1.0})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    for i, k in [(r["doc_id"], r["count"]) for r in out.groupBy("doc_id").count().limit(50).collect()]:
        u = (int(hashlib.md5(f"42:{i}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        mean = 15_000 / 5_000 if i % 4 == 0 else 5_000 / 10_000
        p, c, want = np.exp(-mean), np.exp(-mean), 0
        while c < u:
            want += 1
            p *= mean / want
            c += p
        assert k == want


def test_large_means(spark):
    d = spark.createDataFrame([(i, "rare") for i in range(5)] + [(i + 10, "rest") for i in range(5000)], "doc_id long, source string")
    n = mixing.mix(d, weights={"rare": 1.0}).count()
    assert abs(n - 5005) < 400


def test_mix_of_odd_rows(odd, none):
    out = mixing.mix(odd, size=3.0)
    assert out.columns == [*odd.columns, "mix_copy_"] and out.where("source is null").count() > 0 and out.count() > odd.count()
    assert mixing.mix(none).count() == 0


# pipeline


def test_pipeline_stages(spark, odd, none, small):
    cols = corpus_pipeline.COLUMNS
    docs = odd.select(*cols).withColumn("doc_id", F.col("doc_id") + 10**6)  # no id has a label
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0
        out = stage(spark, docs, small)
        if name != "token_ids":
            assert out.columns == cols
        out = stored(out)
        if name == "quality_rules":
            assert sorted((r["doc_id"] or 10**6 - 1) - 10**6 for r in out.collect()) == [-1, 3, 4, 4, 5, 6, 7, 10]
        if name == "near_duplicates":
            assert sorted(r["doc_id"] - 10**6 for r in out.collect()) == [3, 4, 10]
        if name == "token_ids":
            assert out.count() == docs.count()
        docs = out


def test_pipeline_takes_every_label(spark, tmp_path):
    """Its threshold is that of all labels, and the documents come through whole."""
    ids, docs, labels = two_wordings(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length("text").cast("long").alias("n_chars"))
    out = corpus_pipeline.quality_rules(spark, docs.withColumn("llr", F.lit(9)), str(tmp_path))
    kept = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert out.columns == corpus_pipeline.COLUMNS and sum(i in kept for i in ids) >= 0.99 * len(ids)
    assert all(kept.get(r["doc_id"], tuple(r)) == tuple(r) for r in docs.collect())


def test_pipeline_keeps_by_row(spark):
    """Unlike texts of one id all stay; rows without an id go if they are near any row that stays, and stay once if not."""
    own, other, alone = prose(100, 21), prose(100, 22), prose(100, 23)
    near_alone = alone.replace(alone.split()[50], "zz")
    rows = [(7, own), (7, other), (7, other), (7, ""), (3, SHARED), (9, EDITED), (None, SHARED), (None, alone), (None, alone), (None, near_alone), (None, EDITED), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", None) for i, t in rows], DOCS)
    got = [tuple(r)[:2] for r in corpus_pipeline.near_duplicates(spark, docs.repartition(5), "").collect()]
    left = [x for x in got if x[1] not in (alone, near_alone)]
    assert sorted(left, key=str) == sorted([(7, own), (7, other), (7, ""), (3, SHARED), (None, None)], key=str)
    assert len(got) == len(left) + 1


def test_pipeline_against_brute_force(spark, small):
    """What each stage keeps of the smallest table, by other means."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = corpus_pipeline.quality_rules(spark, docs, small)
    kept = stored(one)
    texts = dict(plain(docs))
    for i, t in plain(kept):
        w = WORD.findall(t)
        assert len(w) >= 50 and texts[i] == t
    two = stored(corpus_pipeline.near_duplicates(spark, kept, small))
    assert sorted(r["doc_id"] for r in two.collect()) == [i for i, _, _, k in brute_components(plain(kept)) if k]
    three = stored(corpus_pipeline.decontamination(spark, two, small))
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 12]) for w in items for k in range(len(w) - 11)}
    gone = {r["doc_id"] for r in two.collect()} - {r["doc_id"] for r in three.collect()}
    full = {i for i, t in plain(two) if any(tuple(w[k : k + 12]) in runs for w in [re.findall(r"[^\W_]+", t.lower())] for k in range(len(w) - 11))}
    assert full <= gone and len(gone) <= len(full) + 2
    four = stored(corpus_pipeline.source_mixing(spark, three, small))
    five = corpus_pipeline.token_ids(spark, four, small)
    tok = Tokenizer.from_file(BPE)
    assert five.agg(F.sum("n_tokens")).first()[0] == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in plain(four))


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op6_chat", "op7_warc", "op8_near_dup", "op10_mixing"])
def test_queries_agree_with_their_sql(spark, small, name):
    import duckdb

    from lamella.llm import queries

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(want, key=str)
