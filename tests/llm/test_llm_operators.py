"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, extra columns."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, decontaminate, mixing, omh_dedup, quality_ledger, sharding, token_counts, toxicity, url_reputation, warc
from gridloom.llm._shared import word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", 0) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t\n", "one", "a b\x0bc\x1cd", "é ü\u00a0x", "<|endoftext|> and <|endoftext|>", "it's  3.14\n\n  the end ", "x" * 50_000, " ".join(words(1, 20_000)), " ".join(words(2, 50)), " ".join(words(2, 50))]


def test_token_counts_equal_the_library_on_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, "it's a dog's 3rd life don't " * 3000, "naïve — test's\n\tend 12 34" * 5000]
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(whole.encode(t or "", add_special_tokens=False))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 1024)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_pieces_do_not_change_counts(name):
    encode, may_cut = token_counts.load(name)
    texts = ["the quick brown fox's 12 jumps, over it " * 40, "a\u0301 b\u0301 c d", "<|endoftext|> x " * 30]
    assert token_counts.lengths(texts, encode, may_cut, 64, 16) == encode(texts)
    if may_cut:
        assert token_counts.lengths(texts, token_counts.memoized(encode, 5), may_cut, 64, 16) == encode(texts)


def test_texts_without_spaces_are_cut_and_not_kept():
    r = random.Random(6)
    encode, may_cut = token_counts.load("byte_bpe_50k.json")
    assert may_cut
    letters = "".join(chr(c) for c in range(97, 123)) + "0123456789"
    texts = ["".join(r.choice(letters) for _ in range(30_000)), "".join(r.choice("日本語文字。、列") for _ in range(9000)), "x" * 5000, "a²3½b4" * 900]
    assert max(map(len, token_counts.pieces(texts[0], 256))) < 400
    count = token_counts.memoized(encode)
    assert token_counts.lengths(texts, count, may_cut, 1 << 12, 256) == encode(texts)
    known = count.__closure__[[c for c in count.__code__.co_freevars].index("known")].cell_contents
    assert max(map(len, known)) <= token_counts.SEGMENT_CHARS
    assert not token_counts.cuts_are_safe({"pre_tokenizer": {"type": "Metaspace"}}) and not token_counts.cuts_are_safe({})
    assert not token_counts.cuts_are_safe({"pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": [{"content": "<|v 1|>"}]})


def brute_repeats(ws: list[str]) -> int:
    grams = Counter(tuple(ws[p : p + 8]) for p in range(len(ws) - 7))
    return len({p + k for p in range(len(ws) - 7) if grams[tuple(ws[p : p + 8])] > 1 for k in range(8)})


def test_quality_measures(spark):
    r = random.Random(3)
    texts = [*ODD, "same line here\nsame line here\n \n \nother", " ".join(r.choice("ab") for _ in range(300)), " ".join(words(4, 30) * 2), "a#b $% <|> x"]
    got = {x.doc_id: x for x in quality_ledger.ledger(docs_of(spark, texts)).collect()}
    for i, t in enumerate(t or "" for t in texts):
        ws = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == (len(ws), sum(map(len, ws)), dup, brute_repeats(ws))
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert bool(got[i].failed_bits & 3) == (len(ws) < 20 or 100 * brute_repeats(ws) > 30 * len(ws))


def test_ablations(spark):
    led = quality_ledger.ledger(docs_of(spark, ODD)).cache()
    bits = [r.failed_bits for r in led.collect()]
    whole = quality_ledger.mask("v1")
    for r in quality_ledger.ablations(led).collect():
        bit = 1 << quality_ledger.RULES[r.rule][0]
        assert r.failed == sum(bool(b & bit) for b in bits)
        assert r.failed_alone == sum(b & whole == bit for b in bits)
        assert r.kept_without == sum(b & whole & ~bit == 0 for b in bits)


def test_word_count(spark):
    got = {r.doc_id: r.n for r in docs_of(spark, ODD).select("doc_id", word_count(F.col("text")).alias("n")).collect()}
    assert got == {i: len(WORD.findall(t or "")) for i, t in enumerate(ODD)}


# ---- WARC

PAGES = [(1, "http://a/x", "hello"), (2, None, "hello"), (3, "u\r\nv", None), (4, "u", ""), (5, "u", "WARC/1.1\r\nfake: yes\r\n\r\nbody \r\n\r\n"), (5, "u", "hello"), (None, "u", "hello"), (9, "u", "ü" * 3000)]


def write(spark, tmp_path, rows, **how):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first_id", F.lit(2))
    warc.write_warc(df, f"file://{tmp_path}/w", **how)
    return sorted(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))


def test_warc_round_trip(spark, tmp_path):
    write(spark, tmp_path, PAGES)
    rows = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert not [r for r in rows if r.kind == "gap"]
    head = {}
    for i, _, h in PAGES:
        if i is not None:
            head[h or ""] = max(i, head.get(h or "", i))
    got = Counter((r.record_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows)
    want = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        first = head.get(h or "")
        again = first is not None and first != i
        want[(f"<urn:page:{'null' if i is None else i}>", "revisit" if again else "response", base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw), f"<urn:page:{first}>" if again else None, None if again else raw)] += 1
    assert got == want


def test_warc_least_bytes(spark, tmp_path):
    write(spark, tmp_path, PAGES, least_bytes=6)
    assert {r.record_type for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()} == {"response"}


def archive(spark, tmp_path, n=6):
    files = write(spark, tmp_path, [(i, "u", f"page {i} " * 20) for i in range(n)])
    return b"".join(p.read_bytes() for p in files)


def test_salvage_of_damaged_plain_archive(spark, tmp_path):
    data = archive(spark, tmp_path)
    whole = list(warc.salvage(data))
    assert [r["kind"] for r in whole] == ["record"] * 6
    second = whole[1]
    for at in (second["start"] + 3, data.index(b"Content-Length: ", second["start"]) + 16, second["stop"] - 30, second["stop"] - 3):
        broken = data[:at] + b"#" + data[at + 1 :]
        rows = list(warc.salvage(broken))
        assert [r["record_id"] for r in rows if r["kind"] == "record"] == [r["record_id"] for n, r in enumerate(whole) if n != 1]
        assert [(r["start"], r["stop"]) for r in rows if r["kind"] == "gap"] == [(second["start"], second["stop"])]
    cut = data[: whole[-1]["stop"] - 10]
    assert [r["kind"] for r in warc.salvage(cut)] == ["record"] * 5 + ["gap"]
    assert list(warc.salvage(b"")) == []
    assert [(r["kind"], r["start"], r["stop"]) for r in warc.salvage(b"junk")] == [("gap", 0, 4)]
    assert sum(r["stop"] - r["start"] for r in warc.salvage(b"junk" + data)) == len(data) + 4


def test_salvage_of_damaged_gzip_members(spark, tmp_path):
    data = archive(spark, tmp_path)
    records = [data[r["start"] : r["stop"]] for r in warc.salvage(data)]
    members = [gzip.compress(r, mtime=0) for r in records]
    packed = b"".join(members)
    assert [r["kind"] for r in warc.salvage(packed)] == ["record"] * 6
    broken = bytearray(packed)
    at = len(members[0]) + len(members[1]) // 2
    broken[at : at + 4] = b"\0\xff\0\xff"
    rows = list(warc.salvage(bytes(broken)))
    assert sum(r["kind"] == "record" for r in rows) == 5 and sum(r["kind"] == "gap" for r in rows) == 1
    gap = next(r for r in rows if r["kind"] == "gap")
    assert (gap["start"], gap["stop"]) == (len(members[0]), len(members[0]) + len(members[1]))
    assert [r["kind"] for r in warc.salvage(gzip.compress(data))] == ["record"] * 6
    assert sum(r["kind"] == "record" for r in warc.salvage(gzip.compress(data)[:-20])) >= 4


def test_headers_of_any_length_are_read():
    block = b"HTTP/1.1 200 OK\r\n\r\nx"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: http://a/" + b"u" * 200_000 + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + warc.END
    rows = list(warc.salvage(record * 2))
    assert [r["kind"] for r in rows] == ["record"] * 2 and len(rows[0]["target_uri"]) == 200_009


def test_plain_records_and_members_in_one_file():
    def record(i, body=b"x"):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(block)) + block + warc.END

    def read(data):
        rows = list(warc.salvage(data))
        return [int(r["record_id"][10:-1]) for r in rows if r["kind"] == "record"], [(r["start"], r["stop"]) for r in rows if r["kind"] == "gap"]

    packed = gzip.compress(b"some page")
    broken = b"XX" + record(1, packed)[2:]
    assert read(broken + record(2) + record(3, packed)) == ([2, 3], [(0, len(broken))])
    assert read(record(1) + gzip.compress(record(2)) + record(3)) == ([1, 2, 3], [])
    hurt = bytearray(gzip.compress(record(2)))
    hurt[:2] = b"XX"
    assert read(record(1) + bytes(hurt) + record(3) + gzip.compress(record(4)))[0] == [1, 3, 4]


def small_record(i, body=b"x"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (i, warc.sha1_32(block).encode(), len(block)) + block + warc.END


def test_damaged_first_line_before_gzip_payloads():
    data = b"X" + b"".join(small_record(i, gzip.compress(b"page %d" % i)) for i in range(50))[1:]
    assert [int(r["record_id"][10:-1]) for r in warc.salvage(data) if r["kind"] == "record"] == list(range(1, 50))
    mixed = gzip.compress(small_record(0)) + b"".join(small_record(i) for i in range(1, 10))
    assert [r["kind"] for r in warc.salvage(mixed)] == ["record"] * 10


def test_damage_at_any_offset_loses_one_record_at_most():
    plain = [small_record(i, b"body %d " % i * 9) for i in range(12)]
    packed = [gzip.compress(r, mtime=0) for r in plain]
    for parts in (plain, packed, [p if i % 2 else q for i, (p, q) in enumerate(zip(plain, packed, strict=True))]):
        whole, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
        for at in range(min(1000, len(whole))):
            hurt = whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :]
            rows = list(warc.salvage(hurt))
            got = {int(r["record_id"][10:-1]) for r in rows if r["kind"] == "record" and r["record_id"][10:-1].isdigit()}
            assert got >= set(range(12)) - {int(np.searchsorted(ends, at, side="right"))}, at


def test_members_of_many_records_are_read_in_steps():
    import tracemalloc

    inner = b"".join(small_record(i, b"z" * 100_000) for i in range(300))
    data = gzip.compress(inner)
    tracemalloc.start()
    n = sum(r["kind"] == "record" for r in warc.salvage(data, False))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 and most < len(inner) // 3
    hurt = inner[:150_050] + b"#" + inner[150_051:]
    assert [r["kind"] for r in warc.salvage(gzip.compress(hurt), False)].count("record") == 299


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    files = write(spark, tmp_path, [(i, "u", "x" * 1000) for i in range(40)], file_bytes=10_000)
    assert len(files) >= 8
    assert warc.read_warc(spark, f"file://{tmp_path}/w").where("kind = 'record'").count() == 40


# ---- decontamination


def test_decontamination_finds_copies_and_new_parameters(spark):
    item = "A train from Paris covers 120 km in 3 hours while another from Rome covers 90 km in the same time so how much faster is the first one."
    plain = " ".join(words(7, 40))
    bench = spark.createDataFrame([(1, item), (2, plain), (3, None), (4, "too short"), (2, plain)], "item_id long, text string")
    pre, post = " ".join(words(8, 60)), " ".join(words(9, 60))
    moved = item.replace("Paris", "Oslo").replace("Rome", "Bern").replace("120", "200").replace("90", "75")
    broken = item.replace("120 km", "120 km in 3 hours or 7 km") + " extra"
    clash = {c: F.lit("x") for c in ("item_id", "m", "coverage", "position")}
    texts = [f"{pre}. {item} {post}", f"{pre}. {moved} {post}", f"{pre} {plain} {post}", f"{pre} {plain.upper()} {post}", pre, None, "", " ".join(plain.split()[:15]), "so too short. but not too: short", f"{pre} " + "*** ".join(plain.split()) + f"%%% {post}"]
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.leaks(docs_of(spark, texts).withColumns(clash), bench).distinct().collect()}
    assert got == {(0, 1): False, (1, 1): True, (2, 2): False, (3, 2): False, (8, 4): False, (9, 2): False}
    assert broken
    kept = [r.doc_id for r in decontaminate.clean(docs_of(spark, texts).withColumns(clash), bench).orderBy("doc_id").collect()]
    assert kept == [4, 5, 6, 7]
    # Blocks of the table give the same.
    small = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, texts), bench, block_windows=40).collect()}
    assert small == set(got)


def test_decontamination_with_odd_benchmarks(spark):
    text = " ".join(words(11, 30))
    docs = docs_of(spark, [text, None])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, empty).count() == 0 and decontaminate.clean(docs, empty).count() == 2
    odd = spark.createDataFrame([(None, text), (3, text), (4, "...")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id or -1) for r in decontaminate.leaks(docs, odd).collect()) == [(0, 3)]
    assert decontaminate.leaks(docs.limit(0), odd).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "move 5 boxes then take 5 more boxes and put 5 back and paint 5 of them red before lunch is over today"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    same, other = item.replace("5", "9"), item.replace("5", "9", 1).replace("5", "4", 1)
    got = [r.doc_id for r in decontaminate.leaks(docs_of(spark, [same, other]), bench).collect()]
    assert got == [0]


def found(item, text):
    items = [("1", item)] if isinstance(item, str) else [(str(i), t) for i, t in enumerate(item)]
    return decontaminate.Index(items).find(text, decontaminate.Codes(), decontaminate.COVER)


def test_copies_of_items_with_equal_windows_are_found():
    item = "Write 3 on the first line of the page. Write 5 on the first line of the page."
    assert found(item, item) == [("1", 1.0, False, 0)]
    pre = " ".join(words(61, 30))
    assert found(item, f"{pre}. {item} {pre}") == [("1", 1.0, False, 30)]
    assert [m[2] for m in found(item, item.replace("3", "8"))] == [True]


def test_copies_of_items_made_of_slots_are_found():
    sums = "12 + 7 = 19, 8 + 5 = 13, 6 + 9 = 15"
    for item in (sums, "5 plus 7", "so Anna Bob Carl Dora Emil Fritz Gina Hans Ida", "12 15 7 3 4 9 2 5 8", "Alice Bob 3 km Carol 5 kg"):
        assert found(item, item) == [("1", 1.0, False, 0)]
        assert found(item, f"Well then we read: {item.upper()}. and more of it")[0][:3] == ("1", 1.0, False)
    assert found("5 plus 7", "6 plus 7") == []
    assert found("12 15 7 3 4 9 2 5 8", "11 15 7 3 4 9 2 5 8") == []


def test_names_at_the_beginning_of_sentences_and_in_other_case():
    item = "Tom buys 12 apples at the market. Anna buys 7 apples at the shop. How many apples do they have now?"
    moved = item.replace("Tom", "Ben").replace("Anna", "Mia")
    assert [m[:3] for m in found(item, moved)] == [("1", 1.0, True)]
    for copy in (item.lower(), item.upper(), item.title()):
        assert [m[:3] for m in found(item, copy)] == [("1", 1.0, False)]
    assert [m[2] for m in found(item, moved.replace("12", "twelve"))] == [True]


def test_slots_are_consistent_both_ways():
    item = "when Alice has 3 coins and Bob has 5 coins then how many coins does Alice need so that Bob has fewer"
    assert len(found(item, item.replace("Alice", "Carol").replace("Bob", "Dan").replace("3", "4"))) == 1
    assert found(item, item.replace("Alice", "Carol").replace("Bob", "Carol")) == []


def test_a_template_of_many_items_is_one_class():
    items = [f"move {n} boxes to the left and {n + 1} boxes to the right before noon" for n in range(3000)]
    assert found(items, items[77]) == [("77", 1.0, False, 0)]
    assert found(items, "move 90000 boxes to the left and 5 boxes to the right before noon") == [("0", 1.0, True, 0)]


def test_repetitive_items_in_repetitive_texts_stay_cheap():
    import time

    item = " ".join(["step by step we add one more line to the list"] * 20)
    text = " ".join(["step by step we add one more line to the list"] * 2000)
    began = time.perf_counter()
    assert found(item, text)[0][:3] == ("1", 1.0, False)
    assert found(item, text.replace("list", "lists", 1))[0][:3] == ("1", 1.0, False)
    assert time.perf_counter() - began < 4


def test_decontamination_against_brute_force(spark):
    # Planted copies with words around them, some with edits; brute force: share of the item's windows in the text.
    r, items = random.Random(91), [" ".join(words(9100 + i, 12 + i)) for i in range(30)]
    texts = []
    for i in range(300):
        own, ws = words(9300 + i, 80), items[i % 30].split()
        for _ in range(i % 5):
            ws[r.randrange(len(ws))] = "zz"
        texts.append(" ".join(own[:40] + ws[: len(ws) if i % 7 else len(ws) // 2] + own[40:]))
    want = set()
    for d, t in enumerate(texts):
        ws = t.split()
        here = {tuple(ws[p : p + 8]) for p in range(len(ws) - 7)}
        for i, item in enumerate(items):
            own = item.split()
            grams = [tuple(own[p : p + 8]) for p in range(len(own) - 7)]
            if sum(g in here for g in grams) >= 0.6 * len(grams):
                want.add((d, f"item {i}"))
    bench = spark.createDataFrame([(f"item {i}", t) for i, t in enumerate(items)], "item_id string, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs_of(spark, texts), bench).collect()} == want and len(want) > 100


# ---- urls


def test_url_parts_rules_and_posteriors(spark):
    urls = ["http://A.Example.com/en/x?y", "http://www.example.com/en/1", "https://x.www.example.com/en/", "http://example.com", "http://example.com?q=/en/", "https://b.net/es/1", "net/es/", None, "", "http://", "x://y://z/p#f", "http://bad.org/1", "http://bad.org/2", "http://good.org/1"]
    want = [("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x.www.example.com", "/en/", "www.example.com/en/", "allow"), ("example.com", "", None, "allow"), ("example.com", "", None, "allow"), ("b.net", "/es/1", "net/es/", "block")]
    want += [("", "", None, "allow")] * 4 + [("y:", "//z/p", None, "allow"), ("bad.org", "/1", None, "block"), ("bad.org", "/2", None, "block"), ("good.org", "/1", None, "allow")]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1000 + i, f"http://bad.org/{i}") for i in range(60)] + [(2000 + i, f"http://good.org/{i}") for i in range(60)] + [(None, "http://good.org/n")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("bad", F.lit(5)).withColumn("n", F.lit(1))
    marks = spark.createDataFrame([(1000 + i, 1) for i in range(60)] + [(2000 + i, 0) for i in range(60)] + [(2000, None), (None, 1)], "id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, marks).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i in range(len(urls))] == want
    none = url_reputation.judge(pages, marks.limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none if r.rule is None} == {"allow"}


def test_hosts_without_labels_inherit_from_domain_and_suffix(spark):
    rows, marks = [], []
    for d in range(40):
        for i in range(30):
            rows.append((100 * d + i, f"http://h{i % 2}.d{d}.{'zz' if d < 20 else 'yy'}/{i}"))
            marks.append((100 * d + i, int(d < 20)))
    new = {-1: "http://new.d3.zz/", -2: "http://new.d30.yy/", -3: "http://other.zz/", -4: "http://other.yy/", -5: "no url"}
    pages = spark.createDataFrame(rows + list(new.items()), "page_id long, url string")
    got = {r.page_id: r for r in url_reputation.judge(pages, spark.createDataFrame(marks, "id long, bad int")).collect()}
    assert [got[i].verdict for i in (-1, -2, -3, -4, -5)] == ["block", "allow", "block", "allow", "allow"]
    assert got[-5].posterior_low is None


def test_limit_follows_the_pooled_share(spark):
    # A base rate of 5 %: hosts of one domain at 40 % are blocked without any host reaching one half.
    rows = [(i, f"http://h{i % 9}.{'bad' if i % 10 == 0 else f'd{i % 70}'}.org/{i}") for i in range(7000)]
    marks = spark.createDataFrame([(i, int(i % 10 == 0 and i % 50 in (0, 10))) for i in range(7000)], "id long, bad int")
    pages = spark.createDataFrame([*rows, (-1, "http://new.bad.org/"), (-2, "http://new.d3.org/")], "page_id long, url string")
    rows = {r.page_id: r for r in url_reputation.judge(pages, marks).collect()}
    got = {i: r.verdict for i, r in rows.items()}
    assert {got[i] for i in range(0, 7000, 10)} == {"block"} and {got[i] for i in range(7000) if i % 10} == {"allow"}
    # Without labels of its own a host's posterior is wider.
    assert rows[-1].posterior_low < rows[0].posterior_low and got[-2] == "allow"
    assert url_reputation.limit_of(0.5) == 2 / 3 and url_reputation.limit_of(0.0) == 0


def test_suffixes_are_a_parameter(spark):
    host = spark.createDataFrame([("a.b.shop.zz",)], "h string")
    got = host.select(url_reputation.domain_of(F.col("h"), ("shop.zz",)), url_reputation.suffix_of(F.col("h"), ("shop.zz",)), url_reputation.domain_of(F.col("h"))).first()
    assert tuple(got) == ("b.shop.zz", "shop.zz", "shop.zz")


# ---- mixing


def water(sizes, weights, cap):
    total, open_, target = sum(sizes.values()), dict(weights), {}
    left = total
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > cap * sizes[s]]
        if not over:
            target |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.pop(s)
    return target


def test_mixing_targets_and_copies(spark):
    r = random.Random(5)
    sources = [r.choice(["b", "b", "b", "b", "b", "B", "é", None, "tiny"]) for _ in range(3000)]
    sources = [s if s != "tiny" or i % 40 == 0 else "b" for i, s in enumerate(sources)]
    texts = [" ".join(["w"] * (i % 97)) if i % 31 else None for i in range(3000)]
    docs = docs_of(spark, texts, sources).withColumns({c: F.lit("clash") for c in ("size", "seed", "copies", "target", "whole", "key", "chance")})
    plan = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for i, s in enumerate(sources):
        sizes[s] += len((texts[i] or "").split())
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water(sizes, {s: (5, 2, 1)[n % 3] for n, s in enumerate(ordered)}, 3)
    taken = Counter()
    for p in plan:
        s = sources[p.doc_id]
        assert p.source_size == sizes[s] and abs(p.target - want[s]) < 1e-6 * max(1, want[s])
        assert p.taken == p.size * p.copies <= 3 * p.size
        taken[s] += p.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 97
    again = {r.doc_id: r.taken for r in mixing.mix_plan(docs.repartition(7)).collect()}
    assert again == {p.doc_id: p.taken for p in plan}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({p.doc_id: p.copies for p in plan if p.copies})


def test_mixing_empty(spark):
    assert mixing.mix(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert mixing.mix_plan(docs_of(spark, [None, ""])).count() == 2


# ---- near duplicates


def edit(ws, seed, n):
    r, out = random.Random(seed), list(ws)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_is_exact():
    r = random.Random(1)
    for _ in range(400):
        a = [r.choice("abcd") for _ in range(r.randint(0, 14))]
        b = [r.choice("abcd") for _ in range(r.randint(0, 14))] if r.random() < 0.4 else [x for x in a if r.random() < 0.85]
        d = levenshtein(a, b)
        for most in range(0, 16):
            assert omh_dedup.aligned(a, b, most) == (d <= most), (a, b, most, d)


def test_occurrence_labels_and_order():
    with np.errstate(over="ignore"):
        a = omh_dedup.kmers(["x"] * 30, {})
        assert len(set(a.tolist())) == len(a) == 26
        ws = words(3, 200)
        same = omh_dedup.order_minhash(omh_dedup.kmers(ws, {}))
        turned = omh_dedup.order_minhash(omh_dedup.kmers(ws[100:] + ws[:100], {}))
        assert (same == omh_dedup.order_minhash(omh_dedup.kmers(ws, {}))).all()
        assert (same == turned).mean() < 0.9


def test_near_duplicate_classes(spark):
    texts, want = [], []
    for g in range(40):
        base = words(100 + g, 60 + 7 * g)
        first = len(texts)
        for v in range(1 + g % 5):
            texts.append(" ".join(edit(base, 1000 * g + v, v and 2)))
            want.append(first)
        texts.append(" ".join(base))
        want.append(first)
    odd = len(texts)
    texts += [None, None, "", "", " ", "one", "one", "a b c d e f", "a b c d e g"]
    want += [odd, odd + 1, odd + 2, odd + 2, odd + 4, odd + 5, odd + 5, odd + 7, odd + 8]
    docs = docs_of(spark, texts).withColumns({c: F.lit("x") for c in ("k", "label", "count", "id", "leader", "class_id", "text_key")})
    got = {r.doc_id: r for r in omh_dedup.near_duplicates(docs).collect()}
    assert [got[i].class_id for i in range(len(texts))] == want
    assert [got[i].class_size for i in range(len(texts))] == [Counter(want)[w] for w in want]
    kept = omh_dedup.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids) == set(want) and {i for i, n in ids.items() if n > 1} == {odd, odd + 1}


def test_shared_passage_is_no_duplicate(spark):
    passage = " ".join(words(5, 60))
    texts = [" ".join(words(500 + i, 150)) + " " + passage + " " + " ".join(words(900 + i, 150)) for i in range(60)]
    got = omh_dedup.near_duplicates(docs_of(spark, texts)).collect()
    assert {r.class_size for r in got} == {1}


def test_pairs_that_met_only_strangers_are_linked(spark, monkeypatch):
    # All texts share a passage; one pair is alike, and its common buckets are led by texts unlike both.
    passage, r = words(51, 300), random.Random(52)
    texts = [" ".join(passage + words(5200 + i, 110)) for i in range(40)]
    pair = passage + words(53, 110)
    texts += [" ".join(edit(pair, 54 + v, 30)) for v in range(2)]
    r.shuffle(texts)
    near = sorted(i for i, t in enumerate(texts) if len(set(t.split()) & set(pair)) > 330)
    assert len(near) == 2

    def sketches(text, *_):
        # Every text is in the buckets of the passage, none in any other.
        return F.when(F.size(F.split(text, " ")) > 0, F.array([F.lit(j).cast("long") for j in range(omh_dedup.SKETCHES)]))

    monkeypatch.setattr(omh_dedup, "sketch_column", sketches)
    for cell, few in ((2048, 16), (3, 0)):
        monkeypatch.setattr(omh_dedup, "CELL", cell)
        monkeypatch.setattr(omh_dedup, "FEW", few)
        monkeypatch.setattr(omh_dedup, "BLOCK", cell)
        got = {r.doc_id: r.class_id for r in omh_dedup.near_duplicates(docs_of(spark, texts)).collect()}
        assert got == {i: near[0] if i in near else i for i in range(len(texts))}


def test_shared_words_is_the_multiset_intersection():
    r = random.Random(2)
    texts = [[r.choice("abcdefgh") for _ in range(r.randint(0, 30))] for _ in range(12)]
    got = omh_dedup.shared_words(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert i == j or got[i, j] == (Counter(a) & Counter(b)).total()


def test_all_pairs_that_share_a_template_and_align_are_linked(spark):
    # 75 of 100 words are a template of all texts; pairs are alike in the rest, up to the operator's own limit.
    template, texts = words(71, 75), []
    for i in range(200):
        own = words(7200 + i, 25)
        texts += [" ".join(template + own), " ".join(edit(template, 7300 + i, 6) + edit(own, 7600 + i, 3))]
    got = {r.doc_id: r.class_id for r in omh_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    ws, near, met = [t.split() for t in texts], 0, 0
    with np.errstate(over="ignore"):
        sketch = [omh_dedup.order_minhash(omh_dedup.kmers(w, {})) for w in ws]
    for i in range(len(texts)):
        for j in range(i):
            if omh_dedup.aligned(ws[i], ws[j], 20) and (sketch[i] == sketch[j]).any():
                near += 1
                met += got[i] == got[j]
    assert near >= 150 and met == near
    assert len(set(got.values())) >= 200  # pairs of different texts stay apart


def test_rare_words_of_aligned_texts_meet():
    r = random.Random(8)
    often = np.zeros(omh_dedup.COUNTERS, np.int64)
    pool = words(81, 60)
    for _ in range(200):
        a = [r.choice(pool) for _ in range(r.randint(1, 60))]
        b = edit(a, r.random(), r.randint(0, max(0, len(a) // 5)))
        x, y = (omh_dedup.labelled_words(" ".join(w)) for w in (a, b))
        most = int(0.2 * max(len(a), len(b)) + 1e-9)
        if omh_dedup.aligned(a, b, most):
            first = lambda h: set(h[omh_dedup.rarest(h, often, 0.8)].tolist())
            assert first(x) & first(y)


def test_word_counters_add_up_over_tasks(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(bytes([t % 3] * 16), " ".join(words[t::7] + words[:5] * 2)) for t in range(20)] + [(bytes([9] * 16), "")]
    held, labels = np.zeros(omh_dedup.COUNTERS, np.int64), {}
    for label, text in rows:
        for at in omh_dedup.counter_of(omh_dedup.labelled_words(text)).tolist():
            held[at] += 1
            labels.setdefault(at, set()).add(label)
    want = np.array([n if len(labels.get(at, ())) > 1 else 0 for at, n in enumerate(held)])
    for tasks in (1, 6):
        got = omh_dedup.word_counters(spark.createDataFrame(rows, "label binary, text string").repartition(tasks), omh_dedup.labelled_words)
        assert (got == want).all() and want.any()
    none = omh_dedup.word_counters(spark.createDataFrame([], "label binary, text string"), omh_dedup.labelled_words)
    assert not none.any()


def test_places_of_frequent_and_rare_words(monkeypatch):
    r = random.Random(12)
    a = [r.randrange(400) ** 2 // 400 for _ in range(5000)]
    for bits in (1 << 29, 5000 * 20):
        monkeypatch.setattr(omh_dedup, "MASK_BITS", bits)
        for most in (3, 700):
            places, full = omh_dedup.Places(a, most), (1 << (2 * most + 1)) - 1
            for j in range(0, 5000, 97):
                for w in (a[j], 0, 399, 1000):
                    want = sum(1 << i for i in range(2 * most + 1) if 0 <= j - most + i < len(a) and a[j - most + i] == w)
                    assert places.band(w, j) & full == want


def test_alignment_of_very_long_texts_needs_memory_in_proportion():
    import resource

    a = [f"w{i}" for i in range(200_000)]
    b = [w if i % 50 else f"x{i}" for i, w in enumerate(a)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert omh_dedup.aligned(a, b, 5000)
    assert not omh_dedup.aligned(a, a[100_000:] + a[:100_000], 5000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_near_duplicates_of_repeated_rows(spark):
    base = words(41, 200)
    texts = [" ".join(edit(base, 40 + v, v and 3)) for v in range(5)] + [" ".join(words(42, 90))]
    docs = docs_of(spark, texts)
    got = omh_dedup.near_duplicates(docs.unionByName(docs).unionByName(docs)).collect()
    assert Counter(tuple(r) for r in got) == Counter({(i, 0 if i < 5 else 5, 15 if i < 5 else 3): 3 for i in range(6)})


def test_near_duplicates_empty(spark):
    assert omh_dedup.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_recall_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    shingles = {r.doc_id: {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} for r in rows if (w := WORD.findall(r.text or ""))}
    got = {r.doc_id: r.class_id for r in omh_dedup.near_duplicates(docs).collect()}
    ids = sorted(shingles)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = shingles[a], shingles[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                assert got[a] == got[b], (a, b)


# ---- toxicity


def test_toxicity_learns_and_scores(spark):
    r = random.Random(9)
    bad = ["zorgle", "blimpf", "quarx"]
    texts, marks = [], []
    for i in range(1500):
        ws = words(i, 60)
        toxic = i % 10 == 0
        if toxic:
            ws[r.randrange(60)] = r.choice(bad)
        texts.append(" ".join(ws))
        if i % 2 == 0:
            marks.append((i, int(toxic)))
    labels = spark.createDataFrame(marks + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = docs_of(spark, [*texts, None, ""]).withColumn("score", F.lit(1)).withColumn("y", F.lit(1))
    got = {x.doc_id: x for x in toxicity.score(docs, labels).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 1500]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got.values())
    assert np.mean([x.predicted == (x.doc_id % 10 == 0) for x in held]) > 0.97
    assert got[1500].predicted == got[1501].predicted == 0
    kept = {x.doc_id for x in toxicity.reject(docs, labels).collect()}
    assert 1500 in kept and len([i for i in kept if i < 1500 and i % 10]) > 1330


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    # One id has most rows and a text of 40,000 words: one row an id is learned from, in any order of the rows.
    texts = [" ".join(words(i, 30)) + (" zorgle" if i % 5 == 0 else "") for i in range(400)]
    docs = docs_of(spark, [*texts, " ".join(words(99, 40_000))])
    many = docs.unionByName(docs.where("doc_id = 400").crossJoin(spark.range(300)).drop("id"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(401)], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(many.repartition(9), labels)
    assert (a.buckets == b.buckets).all() and np.allclose(a.weights, b.weights)
    lengths = [len(bytes(r.f)) // 4 for r in docs.select(toxicity.feature_column(F.col("text"), 100).alias("f")).collect()]
    assert max(lengths) == 100 and toxicity.fit(docs, labels, unlabelled=50).bias < 0


def test_risk_and_gradient_against_plain_loops(monkeypatch):
    # Two steps of Adam written out with the published risk, numeric gradients and no vector operations.
    r = random.Random(77)
    rows = [np.array(sorted({r.randrange(6) for _ in range(3)}), np.int32) for _ in range(40)]
    positive = np.array([i % 4 == 0 for i in range(40)])
    monkeypatch.setattr(toxicity, "select", lambda *a: np.arange(6, dtype=np.int32))
    prior, l2, rate = 0.2, 1e-4, 0.1

    def pieces(w, b):
        f = [b + sum(w[j] for j in row) for row in rows]
        loss = lambda x: float(np.log1p(np.exp(-x)))
        p = [x for x, y in zip(f, positive) if y]
        u = [x for x, y in zip(f, positive) if not y]
        up = prior * sum(loss(x) for x in p) / len(p)
        rest = sum(loss(-x) for x in u) / len(u) - prior * sum(loss(-x) for x in p) / len(p)
        return up, rest

    def target(theta):
        up, rest = pieces(theta[:6], theta[6])
        return up + rest if pieces(*state)[1] >= 0 else -rest

    theta = [0.0] * 6 + [float(np.log(prior / (1 - prior)))]
    m, v = [0.0] * 7, [0.0] * 7
    for step in (1, 2):
        state = (theta[:6], theta[6])
        grad = []
        for j in range(7):
            up, down = theta.copy(), theta.copy()
            up[j] += 1e-5
            down[j] -= 1e-5
            grad.append((target(up) - target(down)) / 2e-5 + (l2 * theta[j] if j < 6 else 0))
        for j in range(7):
            m[j] = 0.9 * m[j] + 0.1 * grad[j]
            v[j] = 0.999 * v[j] + 0.001 * grad[j] ** 2
            theta[j] -= rate * (m[j] / (1 - 0.9**step)) / ((v[j] / (1 - 0.999**step)) ** 0.5 + 1e-8)
    got = toxicity.train(rows, positive, prior, steps=2)
    assert np.allclose(got.weights, theta[:6], atol=1e-4) and abs(got.bias - theta[6]) < 1e-4


def test_toxicity_without_labels(spark):
    got = toxicity.score(docs_of(spark, ["a b", None]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {x.predicted for x in got} == {0} and len(got) == 2
    assert toxicity.score(docs_of(spark, ["a"]).limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


# ---- chat


def test_chat_round_trip(spark):
    convs = {
        -7: [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")],
        1: [("user", "hi"), ("assistant", "a<b\\l\\b"), ("user", ""), ("assistant", "</turn>\n<turn>assistant\n"), ("user", "bye")],
        2: [("system", "only")],
        3: [("assistant", ""), ("assistant", "x")],
        4: [("ro\nle<", "q\\n")],
    }
    rows = [(c, n, r, t) for c, turns in convs.items() for n, (r, t) in enumerate(turns)] + [(5, 0, None, None), (None, 0, "assistant", "z")]
    convs |= {5: [("", "")], None: [("assistant", "z")]}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    ex = chat_format.examples(df)
    got = {r.conv_id: r for r in chat_format.digest(ex).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    one = {r.example: r for r in ex.where("conv_id = 1").collect()}
    assert [one[n].n_context for n in range(3)] == [1, 3, 4]
    assert one[0].formatted == "<turn>user\nhi</turn>\n<turn>assistant\na\\lb\\bl\\bb</turn>\n"
    assert one[2].loss_start is None
    assert chat_format.digest(chat_format.examples(df.limit(0))).count() == 0


# ---- sharding


def test_sharding_law_and_groups(spark):
    r = random.Random(2)
    texts = [f"group {r.randrange(200)}" if i % 3 == 0 else "hot" if i % 7 == 0 else f"single {i} {'é' * (i % 50)}" for i in range(3001)] + [None, None, ""]
    docs = docs_of(spark, texts).withColumn("shard", F.lit("x")).withColumn("g", F.lit(1))
    got = sharding.assign(docs).collect()
    assert len(got) == len(texts)
    counts = Counter(x.shard for x in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(counts[s]))
    for x in got:
        t = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
    where = {}
    for x in got:
        where.setdefault(texts[x.doc_id], set()).add(x.shard)
    small = [s for t, s in where.items() if t and t.startswith("group")]
    assert sum(len(s) == 1 for s in small) >= 0.95 * len(small)
    again = {x.doc_id: (x.shard, x.slot) for x in sharding.assign(docs.repartition(5)).collect()}
    assert again == {x.doc_id: (x.shard, x.slot) for x in got}


def test_sharding_few_rows_and_repeats(spark):
    assert sharding.assign(docs_of(spark, ["a"]).limit(0)).count() == 0
    got = sharding.assign(docs_of(spark, ["a", "a", "b"])).collect()
    assert max(Counter(x.shard for x in got).values()) == 1
    docs = docs_of(spark, [f"t{i}" for i in range(50)]).withColumns({c: F.lit("x") for c in ("shard", "slot", "key", "g", "count", "node")})
    out = sharding.shard_documents(docs.unionByName(docs)).collect()
    assert Counter(x.doc_id for x in out) == Counter({i: 2 for i in range(50)})
    counts = Counter(x.shard for x in out)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert len({(x.shard, x.slot) for x in out}) == 100
