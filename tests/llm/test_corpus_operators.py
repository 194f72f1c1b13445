"""Corpus operators on small tables with nulls, empty texts, ties, repeated
rows and further columns, against plain Python."""

import base64
import hashlib
import random
import re

import public_tokenizers as P
import pytest
import tiktoken

from lowrank.llm import bpe, chunks, ensemble, fingerprints, nearup, packing, rules, secrets, template, warc
from lowrank.llm.common import new_path

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghijklmnoprstuvw") for _ in range(RNG.randint(2, 9))) for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(120, 1)
TEXTS = [None, "", "  \n", "one two", LONG, LONG, LONG + " tail", prose(200, 2), prose(30, 3) + "\n" + prose(70, 99) + "\n" + prose(40, 4),
         prose(50, 5) + "\n" + prose(70, 99) + "\n" + prose(20, 6), "Üñí ß  x\n\n y", "token: abcdefgh12 AKIA" + "A1" * 8 + " " + "0af9" * 9]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_chunk_dedup_removes_shared_passages_only(docs, empty):
    got = {r["doc_id"]: r for r in chunks.remove_repeats(docs).collect()}
    assert got[0]["text"] is None and got[5]["text"] == "" and got[4]["text"] == LONG
    assert got[7]["text"] == TEXTS[7] and got[8]["text"] == TEXTS[8] and got[10]["text"] == TEXTS[10]
    shared = words(prose(70, 99))
    left = got[9]["text"]
    assert not any(" ".join(shared[i:i + 30]) in left for i in range(len(shared) - 29))
    assert left.startswith(prose(50, 5)[:200]) and left.endswith(prose(20, 6)[-60:])
    span = got[9]["removed"][0]
    assert TEXTS[9][:span["start"]] + TEXTS[9][span["end"]:] == left
    assert chunks.remove_repeats(empty).count() == 0


def test_cuts_resist_insertions():
    import pyarrow as pa

    from lowrank.llm.common import Powers
    a = prose(400, 11)
    b = "inserted words here " + a
    doc, _, _, digest = chunks.chunk(pa.array([a, b], pa.large_string()), Powers())
    one, two = set(digest[doc == 0].tolist()), set(digest[doc == 1].tolist())
    assert len(one & two) >= 0.9 * len(one)


def test_fingerprints_and_neighbours(docs, empty, spark):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    assert got[4] == got[5] and got[0] == got[1] == got[2] == fingerprints.NONE and got[4] != got[7]
    rows = docs.select("doc_id", "text").na.fill("", ["text"])
    out = {r["doc_id"]: r for r in fingerprints.with_neighbours(rows, fingerprints._edits, "doc_id long, n_chars long, edited_sha256 string, "
           "fingerprint string, edited_fingerprint string, near_edited double, near_next double", buckets=4).collect()}
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        n, q = texts[(i + 1) % len(texts)], len(t) // 4
        assert out[i]["edited_sha256"] == hashlib.sha256((t[:len(t) - q] + n[:q]).encode()).hexdigest()
    assert out[4]["near_next"] == 1.0 and out[0]["near_next"] == 1.0 and out[2]["near_next"] == 0.0
    assert fingerprints.fingerprints(empty).count() == 0


def test_densify_fills_every_bin():
    import numpy as np
    bins = np.full((3, fingerprints.BINS), fingerprints._EMPTY)
    bins[0, 5] = 1
    bins[1, :100] = np.arange(100)
    bins[2] = 7
    out = fingerprints.densify(bins)
    assert (out != fingerprints._EMPTY).all() and (out[0] == 1).all() and (out[1, :100] == np.arange(100)).all()


def test_warc_round_trip(spark):
    big = "<p>" + "ä" * 600 + "</p>"
    rows = [(1, "u1", big), (5, "u5", big), (3, None, big), (2, "u2", "small"), (4, "u4", "small"), (6, "u6", None), (5, "u5", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archive(pages, new_path(spark, "t"))
    got = warc.read_archive(spark, path).collect()
    assert len(got) == 7
    for r in got:
        body = (dict((a, c) for a, _, c in rows)[r["record"]] or "").encode()
        assert r["payload_digest"] == hashlib.sha1(body).hexdigest() and r["payload_bytes"] == len(body)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if r["record"] in (1, 3) else ("response", None))
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    full = {r["record"]: r for r in warc.reconstruct(spark, path).collect()}
    raw = bytes(full[5]["warc_record"])
    head, http, body = raw.split(b"\r\n\r\n", 2)
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert size == len(http) + 4 + len(big.encode()) and body == big.encode() + b"\r\n\r\n"
    assert bytes(full[1]["payload"]) == big.encode() and big.encode() not in bytes(full[1]["warc_record"])
    path = warc.write_archive(pages.limit(0), new_path(spark, "t"))
    assert warc.read_archive(spark, path).count() == 0


def test_rules_count_and_certify(docs, empty, spark):
    extra = spark.createDataFrame([(100, "a b c a b c a\nx\nx\n\n#%"), (101, "a a a a")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rules.text_stats(docs.select("doc_id", "text").union(extra)).collect()}
    assert [got[100][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [10, 11, 2, 1, 7]
    assert got[101]["n_repeat_words"] == 4 and got[0]["n_words"] == 0 and got[4]["n_words"] == 120
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in rules.quality_rules(docs, labels).collect()}
    assert out[4]["kept"] and not out[0]["kept"] and out[0]["base_failed"]        # too few labels certify nothing
    assert rules.quality_rules(empty, labels).count() == 0


def test_exact_binomial_tail(spark):
    import math
    from pyspark.sql import functions as F
    for n, k, p in ((500, 2, 0.02), (40, 0, 0.1), (3000, 30, 0.02)):
        want = math.log(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))
        got = spark.range(1).select(rules.binomial_tail_log(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert abs(got - want) < 1e-9 * abs(want) + 1e-9


def test_near_classes_match_brute_force(spark):
    base = prose(150, 21).split()
    rows, i = [], 0
    for seed in range(4):
        for cut in range(6):
            w = prose(150, 40 + seed).split()
            w[cut * 20] = f"edit{cut}"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(50, " ".join(base)), (51, " ".join(base)), (52, None), (53, ""), (54, "solo"), (None, "null id text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in nearup.near_classes(docs).collect()}
    assert all(got[j] == j // 6 * 6 for j in range(24))
    assert got[51] == 50 and got[53] == 52 and got[54] == 54 and got[None] is None
    assert sorted(r["doc_id"] for r in nearup.keep_one(docs.where("doc_id is not null")).collect()) == [0, 6, 12, 18, 50, 52, 54]
    assert nearup.near_classes(docs.limit(0)).count() == 0


def test_secrets(docs, empty, spark):
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    t = TEXTS[11]
    assert got[11] == [(0, 0, 17), (18, 1, 38), (39, 2, 75)] and got[0] == [] and got[4] == []
    assert [t[a:b] for a, _, b in got[11]][1].startswith("AKIA")
    r = random.Random(3)
    key = "".join(r.choice(secrets.ENCODINGS["base62"]) for _ in range(64))
    many = spark.createDataFrame([(i, prose(100, i)) for i in range(20)] + [(99, "see " + key + " there")], "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in secrets.mask_secrets(many).collect()}
    assert out[99] == "see [SECRET] there" and out[3] == prose(100, 3)
    assert secrets.find_secrets(empty).count() == 0
    assert secrets.base_spans("token=short password: 'abc") == []


def test_benjamini_hochberg_on_levels():
    assert secrets.control_levels({(0, 100): 3, (0, 0): 97}) == {0: 100}
    assert secrets.control_levels({(1, 10): 5, (1, 0): 95}) == {}


def test_bpe_round_trip(docs, empty):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk_bytes=500, buckets=4), P.path("byte_bpe_50k.tiktoken"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert bytes(got[i]["ids"]) == b"".join(x.to_bytes(4, "little") for x in ids) and got[i]["n_tokens"] == len(ids)
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    assert bpe.encode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert base64.b64encode(b"a") == b"YQ=="


def test_packing(docs, empty):
    out = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), max_tokens=64).collect()
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert {r["doc_id"] for r in out} == set(range(len(TEXTS)))
    assert len(bins) <= -(-sum(r["length"] for r in out) // 64) + 1
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_minimum_bin_slack_is_exact():
    r = random.Random(5)
    for _ in range(30):
        counts = {r.randint(1, 20): r.randint(1, 3) for _ in range(4)}
        room = r.randint(5, 40)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(sums) and all(got.count(n) <= counts[n] for n in got)


def test_classifier_scores_and_drops(spark):
    rows = [(i, prose(60, i) if i % 4 else " ".join(f"{w}###" for w in prose(60, i).split())) for i in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in ensemble.quality_scores(docs, labels).collect()}
    assert len(out) == 302 and all(0 <= r["score"] <= 1 for r in out.values())
    assert all((out[i]["score"] >= 0.3) == (i % 4 > 0) for i in range(300) if out[i]["held_out"])
    none = ensemble.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1


def test_template_extraction(spark):
    menu = "<nav><a href=x>Home</a></nav>"
    page = f"<html><body>{menu}<div class=sidebar>side</div><article><h1>T &amp; t</h1><p>One<br>two <b>three</b><p>Four</article>" \
           "<div id=comments><p>nice</p></div><form>x</form><script>var a='<p>';</script><footer>f</footer></body></html>"
    plain = "<html><body><div>Site menu Home About</div><h2>Title {0}</h2><p>" + "running text number {0} that goes on for a good while here and there</p><div>All rights</div></body></html>"
    rows = [(1, "http://a.example/x", page), (2, None, None), (3, "http://c.example", ""), (4, "http://c.example", "<p>unclosed <i>mark")]
    rows += [(10 + i, "http://b.example/" + str(i), plain.format(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in template.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "T & t\nOne two three\nFour"
    assert got[2] == "" and got[3] == "" and got[4] == "unclosed mark"
    assert "running text number 3" in got[13] and "Site menu" not in got[13] and "All rights" not in got[13]


def test_every_pair_of_a_mixed_bucket_is_compared(spark, monkeypatch):
    def one_bucket(doc, key, weight, n, count):
        import numpy as np
        return np.ones((n, count), np.uint32)

    monkeypatch.setattr(nearup, "samples", one_bucket)
    monkeypatch.setattr(nearup, "BLOCK_TEXTS", 3, raising=False)
    rows = []
    for i in range(40):
        w = prose(60 + 15 * (i % 7 if i < 14 else i), 300 + (i % 7 if i < 14 else i)).split()
        w[i // 7] = "edit"                  # i and i + 7 are near for i < 7
        rows.append((i + 1, " ".join(w)))
    rows += [(0, prose(150, 400)), (99, prose(150, 401))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in nearup.near_classes(docs, 0.7).collect()}
    assert got == {i: i - 7 if 8 <= i <= 14 else i for i, _ in rows}


def hot_group(spark):
    """A text on 100 rows, eight copies of it with four words changed, and 180 others."""
    rows = [(i, prose(400, 500)) for i in range(100)]
    for i in range(8):
        w = prose(400, 500).split()
        for j in range(4):
            w[20 + 90 * j + 10 * i] = f"edit{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, prose(100, 600 + i)) for i in range(180)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_copies_do_not_hide_near_copies(spark):
    got = {r["doc_id"]: r["class_id"] for r in nearup.near_classes(hot_group(spark)).collect()}
    assert got == {i: 0 if i < 108 else i for i in got} and len(got) == 288


def test_different_texts_of_one_id_are_all_kept(spark):
    rows = [(None, prose(80, 700 + i)) for i in range(5)] + [(7, prose(80, 710 + i)) for i in range(5)] + [(None, prose(80, 700)), (7, prose(80, 710)), (9, prose(80, 711))]
    w = prose(80, 712).split()
    rows += [(3, " ".join([*w[:-1], "edit"])), (8, None), (8, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, more string").repartition(3)
    got = nearup.keep_one(docs).collect()
    want = {(i, t or "") for i, t in rows} - {(9, prose(80, 711)), (7, prose(80, 712)), (8, "")}
    assert {(r["doc_id"], r["text"] or "") for r in got} == want and len(got) == len(want)
    assert all(r["more"] == "x" for r in got)


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in template.extract_text(pages).collect()}


def test_template_decides_on_pages_with_articles(spark):
    page = "<html><body><div>Site menu</div><article><div>Share this story now</div><h1>Title {0}</h1><p>Body {0} of the story</p>" \
           "<div>Read our other stories</div></article><div>All rights</div></body></html>"
    teaser = "<html><body><div>Main menu</div><div><h2>Head {0}</h2><p>The text {0} of the page</p></div><article>Teaser {0}</article><div>Imprint</div></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(6)] + [(10 + i, f"http://b.example/{i}", teaser.format(i)) for i in range(6)]
    got = texts_of(spark, rows)
    assert all(got[i] == f"Title {i}\nBody {i} of the story" for i in range(6))
    assert all(got[10 + i] == f"Head {i}\nThe text {i} of the page\nTeaser {i}" for i in range(6))


def test_short_blocks_and_copied_pages_keep_their_text(spark):
    page = "<html><body><div>Site menu</div><h2>Title {0}</h2><p>Yes {0}</p><ul><li>item {0}</li></ul><ul><li><a href=x>link to {0}</a></li></ul><div>All rights</div></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(6)] + [(10 + i, f"http://b.example/{i}", page.format(max(i, 5))) for i in range(8)]
    rows += [(20 + i, "http://c.example/", page.format(9)) for i in range(4)]
    got = texts_of(spark, rows)
    assert all(got[i].split("\n")[:3] == [f"Title {i}", f"Yes {i}", f"item {i}"] and "menu" not in got[i] and "rights" not in got[i] for i in range(6))
    assert all(f"Title {max(i, 5)}\nYes {max(i, 5)}\nitem {max(i, 5)}" in got[10 + i] and "menu" not in got[10 + i] for i in range(8))
    assert all("Title 9\nYes 9\nitem 9" in got[20 + i] for i in range(4))


def test_names_in_attributes_drop_no_article(spark):
    parts = ['<div title="a hidden gem">kept {0}</div>', '<section class="related-work">kept {0}</section>', '<div class="login-tutorial">kept {0}</div>',
             '<article><div class="search-engine-history">kept {0}</div></article>', '<div data-x="aria-hidden=true">kept {0}</div>']
    gone = ['<div hidden>gone</div>', '<div class="comment-list">gone</div>', '<div class="site-footer">gone</div>', '<div aria-hidden="true">gone</div>',
            '<div style="display: none">gone</div>', '<p><div id=comments><p>gone</div>']
    rows = [(i, f"http://h{i}.example/", f"<body><p>text</p>{p.format(i)}</body>") for i, p in enumerate(parts)]
    rows += [(100 + i, f"http://g{i}.example/", f"<body><p>text</p>{p}</body>") for i, p in enumerate(gone)]
    got = texts_of(spark, rows)
    assert all(got[i] == f"text\nkept {i}" for i in range(len(parts)))
    assert all(got[100 + i] == "text" for i in range(len(gone)))


def test_region_drops_boilerplate_without_names(spark):
    """Menu, advert and footer that vary from page to page and carry no telling tag or class."""
    page = ("<html><body><div class=q1><ul><li><a href=x>{1}</a></li></ul></div><div class=q2>{2}</div>"
            "<div class=q3><h1>Title {0}</h1><p>{3}</p><p>{4}</p></div><div class=q4>{5}</div></body></html>")
    rows = [(i, f"http://a.example/{i}", page.format(i, *(prose(n, 1000 + 10 * i + n) for n in (2, 7, 40, 30, 6)))) for i in range(12)]
    got = texts_of(spark, rows)
    assert all(got[i] == f"Title {i}\n{prose(40, 1040 + 10 * i)}\n{prose(30, 1030 + 10 * i)}" for i in range(12))


def test_classes_equal_plain_vectors(spark):
    r = random.Random(4)
    pages = {}
    for i in range(30):
        rows = "".join(f"<li>{r.choice('abcdef')}</li>" for _ in range(r.randint(0, 4)))
        pages[i] = f"<html><body><h1>Site</h1><ul>{rows}</ul><div class=a>" + ("<p>Same</p><h2>Notes</h2>" if i % 3 else "") + f"{i}</div></body></html>"
    rows = [(i, "http://a.example/", pages[i]) for i in pages] + [(99, "http://a.example/", pages[3])]
    parsed = template.parsed_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    different = set(pages.values())
    vectors = {}
    for page in different:
        for name in template.parse(page).tokens:
            vectors.setdefault(template.token_key(name), {}).setdefault(page, 0)
            vectors[template.token_key(name)][page] += 1
    groups = {}
    for key, v in vectors.items():
        if len(v) >= max(3, 0.5 * len(different)):
            groups.setdefault(frozenset(v.items()), set()).add(key)
    want = {frozenset(g) for g in groups.values() if len(g) >= 3}
    one = parsed.where("page_id <> 99").dropDuplicates(["digest"])
    row = template.classes(one).first()
    got = {}
    for t, v in zip(row["tokens"], row["vectors"]):
        got.setdefault(v, set()).add(t)
    assert {frozenset(g) for g in got.values()} == want and len(want) >= 2


def test_classes_nest_or_straddle():
    a, b, c = 1, 2, 3
    order = lambda text: [({"a": a, "b": b, "c": c}[x], i) for i, x in enumerate(text)]
    assert template.nesting(order("abbac")) == ({a: (0, 0), b: (a, 1), c: (0, 0)}, set())
    assert template.nesting(order("aabba")) == ({a: (0, 0), b: (a, 2)}, set())
    assert template.nesting(order("abab"))[1] == {b}
    assert template.nesting(order("abcbca"))[1] == {c}


def test_pages_in_odd_shapes(spark):
    rows = [(1, "http://a.example/", None), (1, "http://a.example/", "<p>twice</p>"), (1, "http://a.example/", "<p>twice</p>"),
            (None, None, "<p>" + "long " * 100_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, tokens string")
    got = sorted((r["page_id"] or 0, len(r["text"])) for r in template.extract_text(pages).collect())
    assert got == [(0, 499_999), (1, 0), (1, 5), (1, 5)]
    assert template.extract_text(pages.limit(0)).count() == 0


def test_chunks_are_named_by_whole_texts(spark):
    import pyarrow as pa

    head = "x" * 100
    rows = pa.record_batch({"doc_id": pa.array([1], pa.int64())})
    assert bpe._digest(rows, [head + "a"]) != bpe._digest(rows, [head + "b"])
    docs = spark.createDataFrame([(None, head + f" word{i % 7} tail{i}") for i in range(40)] + [(3, "a b"), (3, "a b")], "doc_id long, text string").repartition(5)
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN, chunk_bytes=1), path).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in got) == sorted([head + f" word{i % 7} tail{i}" for i in range(40)] + ["a b"] * 2)


def test_two_word_lists_of_a_chunk_are_an_error():
    import numpy as np
    import pyarrow as pa

    one = {"chunk": 5, "bucket": 0, "n": 1, "sizes": bpe._pack(np.array([1])), "ids": bpe._pack(np.array([7]))}
    two = one | {"ids": bpe._pack(np.array([8]))}
    left = pa.table({"chunk": [5], "docs": [[1]], "sizes": [[1]], "ranked": [bpe._pack(np.array([0]))], "packed": [bpe._pack(np.array([0]))], "n_words": [1]})
    assert bpe._reassemble(left, pa.Table.from_pylist([one, one])).column("n_tokens").to_pylist() == [1]
    with pytest.raises(ValueError, match="two lists"):
        bpe._reassemble(left, pa.Table.from_pylist([one, two]))
