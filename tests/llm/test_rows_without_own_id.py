"""Null and repeated ids, repeated rows, ties, long texts, empty tables and
clashing column names; chunks, token ids and the pipeline against plain Python."""

import random
import re
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lowrank.llm import chunks, ensemble, packing, warc
from lowrank.llm.common import new_path

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abcdefghijklmnoprstuvw") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(120, 1)
ROWS = [(None, prose(60, 10 + i) + "\n" + PASSAGE + "\n" + prose(30, 20 + i)) for i in range(4)]
ROWS += [(7, prose(60, 30 + i) + "\n" + PASSAGE + "\n" + prose(30, 40 + i)) for i in range(3)]
ROWS += [(0, prose(50, 50) + "\n" + PASSAGE), (3, prose(200, 51)), (3, prose(200, 51)), (4, prose(200, 51)), (5, None), (5, ""), (6, " \n"), (8, prose(20000, 52)),
         (9, prose(90, 53) + " token: abcdefgh12345678"), (10, "Üñí ß " + prose(70, 54)), (11, "Üñí ß " + prose(70, 54))]
CLASHES = "doc_id long, text string, chunks string, removed int, shared string, place string, whole_row string, log_bytes string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "c", 5, "s", "p", "w", "l", len(t or "")) for i, t in ROWS], CLASHES).repartition(3)


def plain_chunks(text):
    """(bytes of each chunk) by a gear hash of the last 16 bytes, byte by byte."""
    raw, at, out = text.encode(), 0, []
    for i, b in enumerate(raw):
        h = 0
        for x in raw[max(0, i - 15):i + 1]:
            h = (h * 2 + int(chunks._GEAR[x])) % 65536
        ends = i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80
        cut = (b in b" \t\n\v\f\r" and h < 65536 // chunks.WORDS_PER_CHUNK) or (ends and h < chunks._RARE)
        if i + 1 == len(raw) or (cut and i + 1 >= 16):
            out.append(raw[at:i + 1])
            at = i + 1
    return out


def plain_removal(rows, min_words=chunks.MIN_WORDS):
    """{id: text without its repeats} of ids with one text each."""
    cut = {i: plain_chunks(t or "") for i, t in rows}
    first = {}
    for i in sorted(cut, reverse=True):
        first.update(dict.fromkeys(cut[i], i))
    out = {}
    for i, parts in cut.items():
        out[i], run = b"", []
        for c in [*parts, None]:
            if c is not None and first[c] != i:
                run.append(c)
                continue
            joined, run = b"".join(run), []
            out[i] += (b"" if len(re.findall(rb"[^ \t-\r]+", joined)) >= min_words else joined) + (c or b"")
    return {i: t.decode() for i, t in out.items()}


def test_repeats_against_plain_python(odd):
    out = chunks.remove_repeats(odd, spans_as=None)
    assert out.columns == odd.columns
    assert {(r["doc_id"], r["chunks"], r["removed"]) for r in out.collect()} == {(i, "c", 5) for i, _ in ROWS}
    ids = (0, 3, 4, 6, 9, 10, 11)
    want = plain_removal([(i, t) for i, t in ROWS if i in ids])
    have = chunks.remove_repeats(odd.where(F.col("doc_id").isin(*ids))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in have) == sorted((i, want[i]) for i, _ in ROWS if i in ids)


def test_texts_of_one_id_are_documents_of_their_own(odd):
    """The passage is left in one of its eight documents, and all else stays."""
    middle = " ".join(PASSAGE.split()[30:90])
    out = chunks.remove_repeats(odd).collect()
    assert len(out) == len(ROWS) and sum(middle in (r["text"] or "") for r in out) == 1
    starts = sorted(" ".join((t or "").split()[:40]) for i, t in ROWS if i in (None, 7, 0))
    assert sorted(" ".join((r["text"] or "").split()[:40]) for r in out if r["doc_id"] in (None, 7, 0)) == starts
    assert sorted(len(r["text"] or "") for r in out if r["doc_id"] == 3) == [len(prose(200, 51))] * 2
    assert [r["text"] for r in out if r["doc_id"] == 4] == [""]


def test_many_ids_of_several_texts_are_joined(odd, monkeypatch):
    few = sorted((r["doc_id"] or -1, r["text"] or "") for r in chunks.remove_repeats(odd).collect())
    monkeypatch.setattr(chunks, "BROADCAST_IDS", 0)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in chunks.remove_repeats(odd).collect()) == few


def test_token_ids_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    extra = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|", "  two  spaces \n\n x", "don't I'LL 12345 ßñ 漢字   x", "a\tb\r\n"]
    rows = [(i, t) for i, t in ROWS] + [(20 + i, t) for i, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want.append((-1 if i is None else i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    out = packing.pack_documents(docs, path, max_tokens=64).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
    assert [50256] == list(memoryview(packing.piece_encoder(open(path).read())("<|endoftext|>")).cast("I"))


def test_equal_rows_are_spread_when_packed(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x y").alias("text")).repartition(4)
    out = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), max_tokens=64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 3000 and len({r["sequence_id"] for r in out}) == -(-3000 // (64 // out[0]["length"]))


def test_refers_to_comes_from_the_header(spark):
    rows = [(1, "u", "x" * 1200), (4, "u", "x" * 1200), (2, "u", "y" * 1200), (3, "u", "y" * 1200)]
    path = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), new_path(spark, "t"))
    assert {r["record"]: r["refers_to"] for r in warc.read_archive(spark, path).collect()} == {1: 4, 2: 3, 3: None, 4: None}
    heads = spark.read.parquet(f"{path}/headers")
    urn = {r["record"]: re.search(rb"WARC-Record-ID: (\S+)", r["warc_header"])[1].decode() for r in heads.collect()}

    def with_reference(name):
        new, text = new_path(spark, "t"), F.decode("warc_header", "UTF-8")
        heads.withColumn("warc_header", F.encode(F.regexp_replace(text, "WARC-Refers-To: [^\r]*", f"WARC-Refers-To: {name}"), "UTF-8")).write.parquet(f"{new}/headers")
        spark.read.parquet(f"{path}/payloads").write.parquet(f"{new}/payloads")
        return {r["record"]: r["refers_to"] for r in warc.read_archive(spark, new).collect()}

    assert with_reference(urn[3]) == {1: 3, 2: 3, 3: None, 4: None}
    with pytest.raises(Exception, match="not here"):
        with_reference("<urn:uuid:none>")


def test_each_row_is_kept_by_its_own_text(spark):
    rows = [(i, prose(60, i) if i % 4 else " ".join(f"{w}###" for w in prose(60, i).split()), "r", "l") for i in range(300)]
    more = [(None, prose(60, 900), "r", "l"), (None, rows[0][1] + " x###", "r", "l"), (1, rows[4][1], "r", "l")]
    docs = spark.createDataFrame([*rows, *more], "doc_id long, text string, whole_row string, log_bytes string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id long, quality int")
    got = ensemble.keep_good(docs, labels.where("doc_id <> 1"))
    assert got.columns == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert kept == {(i, t) for i, t, *_ in [*rows, *more] if "###" not in t}
    assert ensemble.keep_good(docs.limit(0), labels).count() == 0


def test_tree_paths_are_conjunctions():
    tree = "tree\n  If (feature 3 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 3 > 0.5)\n   Predict: 1.0\n"
    assert ensemble.tree_rules(tree) == [((3, True, 0.5),), ((1, True, 2.0), (3, True, 0.5)), ((1, False, 2.0), (3, True, 0.5)), ((3, False, 0.5),)]


def test_pipeline_stage_by_stage(spark, odd, tmp_path):
    """Every stage of the pipeline on rows with odd ids and clashing names."""
    labels = [(i, int(i % 4 > 0)) for i in range(100, 400)]
    marked = [(i, prose(60, i) if i % 4 else " ".join(f"{w}###" for w in prose(60, i).split()), "c", 5, "s", "p", "w", "l", 1) for i, _ in labels]
    docs = odd.union(spark.createDataFrame(marked, CLASHES))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, str(tmp_path)).cache()
    texts = [r["text"] or "" for r in good.collect()]
    assert good.columns == docs.columns and not any("###" in t for t in texts)
    want = [t or "" for i, t in ROWS if len((t or "").split()) > 40] + [prose(60, i) for i, q in labels if q]
    assert set(want) <= set(texts)
    one = stages["near_dedup"](spark, good, str(tmp_path)).cache()
    left = [r["text"] or "" for r in one.collect()]
    assert one.columns == docs.columns and set(want) <= set(left) and len(left) == len(set(left) - {""}) + left.count("")
    parts = stages["substring_dedup"](spark, one, str(tmp_path)).cache()
    middle = " ".join(PASSAGE.split()[30:90])
    rows = parts.collect()
    assert parts.columns == docs.columns and len(rows) == len(left) and sum(middle in (r["text"] or "") for r in rows) == 1
    assert all(r["n_chars"] == len(r["text"] or "") and r["removed"] == 5 and r["chunks"] == "c" for r in rows)
    clean = stages["secret_scan"](spark, parts, str(tmp_path)).cache()
    rows = clean.collect()
    assert clean.columns == docs.columns and not any("abcdefgh12345678" in (r["text"] or "") for r in rows)
    assert sorted((r["text"] or "") for r in rows if r["doc_id"] != 9) == sorted((r["text"] or "") for r in parts.collect() if r["doc_id"] != 9)
    packed = stages["packing"](spark, clean, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    facts = lambda out: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    assert facts(packed) == facts(whole)


def test_pipeline_on_an_empty_table(spark, odd, tmp_path):
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
