"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plaudit.llm import byte_bpe, fingerprints, language_id, ngram_join, orc_tokens, packing, quality_classifier, quality_rules, revisits, secrets

LONG = " ".join(f"word{at % 997} and{at % 31}" for at in range(60_000))
PLAIN = "The quick brown fox jumps over the lazy dog while many other animals look on and wonder what all this running is about today"
ROWS = [(1, None), (2, ""), (3, "one word"), (4, PLAIN), (4, PLAIN), (4, PLAIN + " but not here"), (5, PLAIN), (None, PLAIN), (6, LONG), (7, "  \n "),
        (8, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" " + PLAIN)]
CLASHES = ("id", "key", "block", "tie", "rules", "quality_score", "row", "spans", "hit", "gone_id", "class_id", "label", "bucket")
BYTE_JSON, RANKS, WORD_JSON = (public_tokenizers.path(f"{name}") for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({
        "lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long")})
    return rows.withColumns({name: F.lit(f"own {name}") for name in CLASHES}).cache()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """A folder with a label table: one null label, one null id, contradicting and missing labels."""
    path = tmp_path_factory.mktemp("tables").as_uri()
    marks = [(4, 1, 0), (4, 0, 0), (5, 1, None), (6, None, 0), (None, 1, 0), (8, 1, 0), (2, 0, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def own_columns(frame, docs):
    assert frame.columns == docs.columns
    return {tuple(row) for row in frame.select(*CLASHES).distinct().collect()} <= {tuple(f"own {name}" for name in CLASHES)}


def test_classifier(spark, docs, folder):
    kept = quality_classifier.keep_good(spark, docs, folder)
    assert own_columns(kept, docs)
    assert quality_classifier.op1_quality_classifier(spark, folder).where("score between 0 and 1").count() == len(ROWS)


def test_rules(spark, docs, folder):
    kept = quality_rules.keep_clean(spark, docs, folder)
    assert own_columns(kept, docs)
    found = {(row.doc_id, row.n_words): row for row in quality_rules.op4_quality_rules(spark, folder).collect()}
    assert found[1, 0].base_failed and found[2, 0].base_failed and found[7, 0].base_failed and not found[7, 0].kept
    assert found[3, 2].word_chars == 7 and found[3, 2].base_failed


def test_duplicates(spark, docs):
    found = ngram_join.near_duplicates(spark, docs).collect()
    assert len(found) == len(ROWS)
    classes = {(row.doc_id, row.tie): row.class_id for row in found}
    assert {name for (doc, _), name in classes.items() if doc in (4, 5)} == {4}
    assert {doc: row for (doc, _), row in classes.items() if doc in (1, 2, 3, 6, 7)} == {1: 1, 2: 2, 3: 3, 6: 6, 7: 7}
    kept = ngram_join.keep_one(spark, docs)
    assert own_columns(kept, docs)
    # both texts of id 4 are in class 4 and stay once each, 8 is near them; the null id stays
    assert sorted(row.doc_id or 0 for row in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 7]


def test_secrets(docs):
    kept = secrets.redacted(docs)
    assert own_columns(kept, docs)
    assert kept.where("text like '%[SECRET]%'").select("doc_id").collect() == [(8,)]
    assert kept.where("text is null").select("doc_id", "n_chars").collect() == [(1, None)]
    assert kept.where("n_chars <> char_length(text)").count() == 0


def test_packing(spark, docs):
    found = packing.packed(spark, docs, BYTE_JSON).collect()
    assert sorted({row.doc_id or 0 for row in found}) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert sum(row.length for row in found if row.doc_id in (1, 2)) == 2
    long = sorted((row for row in found if row.doc_id == 6), key=lambda row: row.piece)
    assert all(row.length == 2048 for row in long[1:]) and long[0].length <= 2048 and len(long) > 10
    assert len({(row.sequence_id, row.offset) for row in found}) == len(found)


def test_tokens(spark, docs, tmp_path):
    path = (tmp_path / "orc").as_uri()
    orc_tokens.write_tokens(docs, path, WORD_JSON)
    found = sorted(orc_tokens.digests(spark, path).collect(), key=lambda row: row.start)
    assert [row.doc_id for row in found] == [None, 1, 2, 3, 4, 4, 4, 5, 6, 7, 8]
    assert all(after.start == row.start + row.n_tokens for row, after in zip(found, found[1:])) and found[0].start == 0
    assert [row.n_tokens for row in found if row.doc_id in (1, 2, 7)] == [1, 1, 1]


def test_byte_bpe(docs):
    rows = byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decoded(rows, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((row.doc_id or 0, bytes(row.bytes).decode()) for row in back) == sorted((doc or 0, text or "") for doc, text in ROWS)


def test_null_characters(spark):
    """A NUL after a space is a character of the text, not the mark of a first segment."""
    from tokenizers import Tokenizer

    from plaudit.llm.library_tokens import spaced_memory
    texts = ["b", "a \0b", "a b", "\0b", "\0", "a \0", "x\0y \0\0z w", " \0b "]
    whole = Tokenizer.from_file(BYTE_JSON)
    expected = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    for memory in (spaced_memory(BYTE_JSON), byte_bpe.segment_memory(RANKS, public_tokenizers.PATTERN)):
        ids, counts = memory.ids(texts)
        assert [own.tolist() for own in np.split(ids, np.cumsum(counts)[:-1])] == expected
    rows = byte_bpe.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decoded(rows, RANKS, public_tokenizers.PATTERN).collect()
    assert {row.doc_id: bytes(row.bytes).decode() for row in back} == dict(enumerate(texts))


def test_language(docs):
    network = language_id.train(docs, language_id.TrainOptions(epochs=1))
    found = {row.doc_id: row for row in language_id.predicted(docs, network).collect()}
    assert {found[doc].lang_pred for doc in (1, 2, 7)} == {"und"} and found[1].score == 0
    assert found[6].lang_pred == "en" and 0 <= found[6].score <= 1
    assert {row.lang_pred for row in language_id.predicted(docs, None).collect()} == {"und"}


def test_fingerprints(spark, docs):
    found = fingerprints.compared(spark, docs).collect()
    assert len(found) == len(ROWS)
    by_text = {row.fingerprint for row in found if row.doc_id in (4, 5, None)}
    assert len(by_text) == 2 and len({row.fingerprint for row in found if row.doc_id in (1, 2)}) == 1
    assert all(0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1 for row in found)
    assert {row.near_next for row in found if row.doc_id == 1} == {1.0}


def test_empty_tables(spark, docs, tmp_path):
    none, path = docs.limit(0), tmp_path.as_uri()
    none.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    for query in (quality_classifier.op1_quality_classifier, secrets.op2_secret_scan, ngram_join.op3_ngram_join, quality_rules.op4_quality_rules,
                  fingerprints.op5_fingerprints, orc_tokens.op6_orc_tokens, language_id.op7_language_id, packing.op8_best_fit_packing,
                  revisits.op9_warc_revisits, byte_bpe.op10_byte_bpe):
        assert query(spark, path).collect() == [], query.__name__


def test_no_labels(spark, docs, tmp_path):
    path = tmp_path.as_uri()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert quality_classifier.keep_good(spark, docs, path).count() == len(ROWS)
    assert quality_rules.keep_clean(spark, docs, path).where("doc_id in (1, 2, 3, 7)").count() == 0


def test_words_after_line_ends_go_to_the_model(monkeypatch):
    """Line ends part words as spaces do, so a word at either side is no segment of its own for each neighbour."""
    from tokenizers import Tokenizer

    from plaudit.llm import library_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = library_tokens.LibraryEncoder(path, words=False)
    others = []
    encode_others = encoder.encode_others
    monkeypatch.setattr(encoder, "encode_others", lambda segments: others.extend(segments) or encode_others(segments))
    cut = library_tokens.spaced_memory(path).cut
    memory = encoder.memory(cut)
    whole = Tokenizer.from_file(path)

    def same(texts):
        ids, sizes = memory.ids(texts)
        return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == [whole.encode(text, add_special_tokens=False).ids for text in texts]

    assert same(["One word.\nTwo, thrée!!\nÀ la íß\nend"]) and others == ["\0One"]
    encoder.border[:] = False  # a vocabulary whose tokens do not tell the borders
    memory.clear()
    assert same(["One word.\nTwo, thrée!!\nÀ la íß\nend"])
    # other blanks beside a line end, no word behind it, marks of our own, and letters that stand for bytes
    assert same(["a\n\nb", "a \nb", "a\n b", "a\r\nb", "a\n", "\nb", "a\n12 b\n's", "a\t\nb c", "a\n\tb", "a\n\0b", "a\n\x01b \x01", "a\nĊ Ġ", "a\n語 b\nªb",
                 "x\n<|endoftext|>\ny", "x\n<|ENDOFTEXT|>\ny", "", "\n", "a  b\nc"])
