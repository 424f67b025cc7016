"""Token counts at all white space, sentence pieces, manifests and spelling variants."""

import random

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.llm import common, licence_scan, manifest, pieces, queries, spelling, sql, token_counts

from . import brute
from .test_llm import DATA, WORDS, docs, empty, odd, odd_texts  # noqa: F401

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def test_token_counts_at_every_letter_and_space():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), token_counts.Counter(WORDS)
    letters = [chr(i) for i in range(0x250)] + [chr(i) for i in range(0x250, 0x110000) if chr(i).isspace()]
    said = [t for c in letters for t in (f"hello{c}", f"hello{c} world", f"{c}hello", f"été{c}\nnext", f"a{c}b", c, f"12{c}", f"É{c}'s")]
    want = [len(e.ids) for e in library.encode_batch(said, add_special_tokens=False)]
    assert own.of(pa.array(said)).tolist() == want


def library_digest(texts):
    from sentencepiece import SentencePieceProcessor

    library, out = SentencePieceProcessor(model_file=MODEL), {}
    for i, t in texts.items():
        ids = library.encode(t or "")
        out[i] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)))
    return out


def awkward(n):
    rnd = random.Random(n)
    letters = [" "] * 6 + list("abcétheing\n\t\r.,▁\xa0日本😀́\x00​<>s/09 ") + ["  ", "\n\n", "the ", " and", "   ", "<s>", "</s>", "<0x0A>", "<unk>", "▁▁"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_pieces_as_the_library(spark, docs, odd, odd_texts, empty):  # noqa: F811
    texts = dict(enumerate([*awkward(3000), " " * 5000, "日本語" * 5000, "\n" * 3000]))
    some = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for df, known in ((some, texts), (docs, {r["doc_id"]: r["text"] for r in docs.collect()})):
        got = {r["doc_id"]: tuple(r)[1:] for r in pieces.digest(pieces.decode(pieces.encode(df, MODEL), MODEL)).collect()}
        assert got == library_digest(known)
    got = pieces.digest(pieces.decode(pieces.encode(odd, MODEL), MODEL)).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == library_digest(odd_texts)
    assert pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0


def test_pieces_with_a_table_that_forgets(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    model = pieces.Model(MODEL)
    own = pieces.ChunkTable(model)
    for said in (awkward(50), awkward(51)):
        assert own.encode(pa.array(said)).to_pylist() == model.library.encode(said)


def test_any_ids_decode_as_in_the_library(spark):
    rnd = random.Random(8)
    ids = [[rnd.choice([0, 1, 2, 259, rnd.randrange(3, 259), rnd.randrange(32000)]) for _ in range(rnd.randrange(12))] for _ in range(500)]
    df = spark.createDataFrame([*enumerate(ids), (1000, None)], "doc_id long, ids array<int>").repartition(2)
    library = pieces.Model(MODEL).library
    got = {r["doc_id"]: r["text"] for r in pieces.decode(df, MODEL).collect()}
    assert got == dict(enumerate(map(library.decode, ids))) | {1000: None}


def proofs(df, fanout=2):
    return sorted([tuple(r) for r in manifest.digest(manifest.manifest(df, carry={"tampered": manifest.changed()}, fanout=fanout)).collect()], key=str)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_manifest(request, which):
    df = request.getfixturevalue(which)
    assert proofs(df) == brute.manifest(rows_of(df))


@pytest.mark.parametrize("n,fanout", [(1, 2), (2, 2), (3, 2), (32, 2), (33, 2), (65, 2), (100, 3), (1025, 2)])
def test_manifest_of_trees_of_every_height(spark, n, fanout):
    rows = [(i // 2 if i > 90 else i, f"t{i % 50}", "é" if i % 4 == 3 else None if i == 2 else "en", None, i if i % 5 else None) for i in range(n)]
    df = spark.createDataFrame([*rows, *rows[:3]], PLAIN).repartition(5)
    got = proofs(df, fanout)
    assert got == brute.manifest(rows_of(df), fanout)
    assert all(r[-1] or r[5] != r[3] for r in got)


def test_manifest_of_nothing_and_of_equal_rows(spark, empty):  # noqa: F811
    assert proofs(empty) == []
    df = spark.createDataFrame([(7, "same", "en", "s", 4)] * 70, PLAIN)
    assert proofs(df) == brute.manifest(rows_of(df))


def test_manifest_with_joins_that_shuffle(spark, docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert proofs(docs) == brute.manifest(rows_of(docs))


def words_of(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_spelling(request, which):
    df = request.getfixturevalue(which)
    want = brute.variants(brute.vocabulary([(r["doc_id"], r["text"]) for r in df.collect()]))
    assert words_of(spelling.spelling_variants(df)) == want


@pytest.mark.parametrize("most", [4, 50, 4096])
def test_spelling_of_crowded_keys(spark, most):
    rnd = random.Random(most)
    known = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(6, 9))): rnd.randrange(5, 4000) for _ in range(700)}
    known |= {w + c: 9 for w in list(known)[:40] for c in "abx"} | {"z" * k: 5**k for k in range(6, 12)}
    df = spark.createDataFrame(list(known.items()), "word string, n long").repartition(3)
    assert words_of(spelling.variants(df, most=most)) == brute.variants(known)


def test_spelling_in_small_batches(spark):
    rnd = random.Random(1)
    known = {"".join(rnd.choice("abc") for _ in range(7)): rnd.randrange(5, 900) for _ in range(400)}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert words_of(spelling.variants(spark.createDataFrame(list(known.items()), "word string, n long"))) == brute.variants(known)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_spelling_of_nothing(empty):  # noqa: F811
    assert spelling.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("name", ["op12_manifest", "op13_spelling_variants"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    found = con.execute(sql.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_extra_columns_dont_clash(spark):
    df = spark.createDataFrame([(i, "spelling spelling spelling spelling spelling spellin x", "en", "s", 3) for i in range(9)], PLAIN)
    more = df.withColumns({c: F.lit(1) for c in ("word", "n", "key", "tree", "size", "lo", "hi", "digest", "_at", "path", "ids", "run", "m", "p", "s")})
    assert words_of(spelling.spelling_variants(df)) == words_of(spelling.spelling_variants(more))
    assert proofs(df) == proofs(more)
    assert pieces.encode(more, MODEL).count() == 9


def test_licences_with_names_titles_and_older_identifiers(spark):
    s = licence_scan.SENTENCES
    bsd = [s["bsd-1"], s["bsd-2"], s["bsd-3"], None, s["bsd-5"], s["bsd-6"]]
    named = lambda n: "\n\n".join(x or f"3. Neither the name of {n} nor the names of its\ncontributors may be used to endorse or promote products derived from this software without specific prior written permission." for x in bsd)
    said = {0: named("Example Inc."), 1: named("the University of Somewhere, its Dept. of Things"), 2: named("the copyright holder"), 3: "\n\n".join(x for x in bsd if x), 4: "MIT License", 5: "// SPDX-License-Identifier: GPL-2.0+", 6: "SPDX-License-Identifier: GPL-2.0", 7: f"{s['gpl2-0']} {s['gpl2-1']} version 2 of the License.", 8: "Licensed under the BSD 3-Clause License."}
    df = spark.createDataFrame(list(said.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licence_scan.scan_licences(df).collect()}
    assert {i: got[i] for i in (0, 1, 2, 3, 4, 6, 7, 8)} == {0: "BSD-3-Clause", 1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "BSD-2-Clause", 4: "MIT", 6: "GPL-2.0-only", 7: "GPL-2.0-only", 8: "BSD-3-Clause"}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: r[3] for r in con.execute(sql.ORACLES["op2_licence_scan"]).fetchall()} == got
