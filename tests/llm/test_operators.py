"""The operators against brute force, exact round trips and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import difference, duck
from plaudit.llm import byte_bpe, fingerprints, language_id, ngram_join, orc_tokens, packing, quality_classifier, quality_rules, revisits, secrets
from plaudit.llm.components import components
from plaudit.llm.queries import ORACLES, QUERIES
from plaudit.llm.text_stats import COUNTS, statistics

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(spark):
    return {row.doc_id: row.text or "" for row in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", ["op3_ngram_join", "op9_warc_revisits"])
def test_counterparts(spark, name):
    assert difference(QUERIES[name](spark, SMALL), duck(SMALL), ORACLES[name]) is None


def labelled(spark, found):
    return found.join(spark.read.parquet(f"{MORE}/labels.parquet").where("quality is not null").select("doc_id", "quality"), "doc_id").toPandas()


def test_classifier_on_held_out_rows(spark):
    found = labelled(spark, QUERIES["op1_quality_classifier"](spark, MORE))
    fold = np.array([zlib.crc32(str(doc).encode()) % 5 == 0 for doc in found["doc_id"]])
    assert (found["held_out"] == fold).all() and (found["predicted"] == (found["score"] >= 0.3)).all()
    held = found[fold]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert held[held["quality"] == 1]["predicted"].mean() > 0.97


def test_isotonic():
    points, means = quality_classifier.isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert means.tolist() == [0, 0.5, 1] and (np.diff(points) > 0).all()


def brute_statistics(text):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[at:at + 8]) for at in range(len(words) - 7))
    marked = {at + k for at in range(len(words) - 7) if windows[tuple(words[at:at + 8])] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0D]", line)]
    return (len(text), len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), len(lines))


def test_statistics(texts):
    some = [*texts.values(), "", " \n", "a b c d e f g h " * 5, "x\x0by\x1cz", "É\U0001F600 |\n|\n|"]
    found = statistics(some)
    assert list(zip(*(found[name].tolist() for name in COUNTS))) == [brute_statistics(text) for text in some]


def test_rules(spark):
    found = labelled(spark, QUERIES["op4_quality_rules"](spark, MORE))
    fine = found[~found["base_failed"]]
    assert fine[fine["quality"] == 1]["kept"].mean() > 0.98 and fine[fine["quality"] == 0]["kept"].mean() < 0.1
    assert not found[found["base_failed"]]["kept"].any()


def test_forest_prefers_sparse_regions():
    rng = np.random.default_rng(1)
    clean, odd = rng.normal(size=(600, 4)), rng.normal(6, 0.3, size=(40, 4))
    forest = quality_rules.grow(clean, np.vstack([clean, odd]), quality_rules.ForestOptions(trees=50))
    assert forest.anomaly(odd).min() > np.quantile(forest.anomaly(clean), 0.95)


def test_hot_groups_of_near_copies(spark):
    """A group larger than a block, of texts near a common one, keeps every link."""
    rng = random.Random(2)
    base = [f"w{at}" for at in range(100)]
    rows = []
    for doc in range(300):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(100)] = f"x{rng.random()}"
        rows.append((doc, " ".join(words)))
    options = ngram_join.JoinOptions(block_texts=40)
    found = {row.doc_id: row for row in ngram_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), options).collect()}
    sets = [set(zip(*(text.split()[at:] for at in range(5)))) for _, text in rows]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert [found[doc].n_links for doc, _ in rows] == links
    assert {row.class_id for row in found.values()} == {0}


def test_components(spark):
    edges = [(at, at + 1) for at in range(60)] + [(100, 101), (102, 101), (200, 200)]
    found = {row.id: row.root for row in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[at] for at in range(61)}) == 1 and found[100] == found[101] == found[102] != found[0]


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, texts):
    rng = random.Random(3)
    parts = ["password", "token ", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCD1234EFGH5678", "é", "\U0001F600", "0123456789abcdef" * 2, "api_key",
             "APIKEY", "Secret", "\n", "abcde"]
    some = [*texts.values(), *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)), "token=abcdef " * 700]
    rows = secrets.scanned(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"))
    found = {row.doc_id: [tuple(span) for span in row.base] for row in rows.select("doc_id", F.col("spans.base").alias("base")).collect()}
    assert [found[at] for at in range(len(some))] == [brute_spans(text) for text in some]


def test_random_strings_are_found(spark):
    rng = random.Random(4)
    import base64
    rows = [(at, f"here {base64.b64encode(rng.randbytes(36)).decode()} there") for at in range(150)]
    rows += [(at, f"here release{at}candidate{at}release{at}candidate there") for at in range(1000, 1150)]
    found = secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string")).where(F.size("spans.every") > 0).select("doc_id").collect()
    hits = [row.doc_id for row in found]
    assert sum(doc < 1000 for doc in hits) > 140 and sum(doc >= 1000 for doc in hits) < 8


@pytest.mark.parametrize("before, after", [("AUTH_KEY=", " there"), ("https://a.com/?sig=", "&page=2"), ("--my_long_client_name_2=", "\n"), ("a==", "")])
@pytest.mark.parametrize("size", [30, 28, 29, 13])  # bytes: no padding, two, one, and 20 characters with their padding
def test_random_values_of_names(before, after, size):
    """The value of name=value is a run of its own, padding stays with it."""
    import base64
    rng = random.Random(8)
    values = [base64.b64encode(rng.randbytes(size)).decode() for _ in range(20)]
    for value in filter(lambda value: re.search("[0-9]", value), values):
        runs = [match.span() for match in re.finditer(secrets.RUN, before + value + after)]
        assert runs[-1] == (len(before), len(before + value))


def test_random_values_are_found(spark):
    import base64
    rng = random.Random(9)
    forms = ["AUTH_KEY={}", "see https://a.com/?sig={}&page=2", "client_id={} there", "'{}'"]
    values = [base64.b64encode(rng.randbytes(size)).decode() for size in [30, 28] * 100]
    rows = [(at, forms[at % 4].format(value)) for at, value in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    clean = {row.doc_id: row.text for row in secrets.redacted(docs).collect()}
    for at in range(4):
        assert sum(clean[doc] == forms[at].format("[SECRET]") for doc in range(at, 200, 4)) > 40, forms[at]


@pytest.mark.parametrize("p", [0.42, 0.80])
def test_copied_string_leaves_the_limit(spark, p):
    """One string that is copied thousands of times counts once in the limit of its length class."""
    rng = random.Random(7)
    import base64
    strings = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(500)]
    scored = spark.createDataFrame([(one,) for one in strings], "one string").select(
        "one", secrets.battery(F.col("one"), F.lit(secrets.B64 + "+/")).alias("p")).collect()
    hot = min(scored, key=lambda row: abs(row.p - p)).one
    letters = "ABCDEFGHIJKLMNOPQRSTabcd0123"  # a part of the alphabet: small p-values, but not all of them tiny
    names = ["".join(rng.choices(letters, k=38)) + "a0" for _ in range(1500)]
    secret = [one for one in strings if one != hot][:300]
    rows = [(at, f"here {one} there") for at, one in enumerate([*secret, *names, hot])]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = once.union(spark.createDataFrame([(10_000 + at, f"copy {hot} {at}") for at in range(3000)], once.schema))
    limit = secrets.limits(often, secrets.ScanOptions())
    assert limit and limit == secrets.limits(once, secrets.ScanOptions())
    hits = [row.doc_id for row in secrets.scanned(often).where(F.size("spans.every") > 0).select("doc_id").collect()]
    found = [sum(low <= doc < high for doc in hits) for low, high in ((0, 300), (300, 1800), (10_000, 13_000))]
    assert found[0] > 260 and found[1] < 60 and found[2] == 3000, (limit, found)


def test_battery_values(spark):
    """p-values against the same tests computed with numpy."""
    value, k = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 16
    digits = np.array([int(char, 16) for char in value], float)
    n = len(digits)
    chi = (np.bincount(digits.astype(int), minlength=k) ** 2).sum() * k / n - n
    above = digits > (k - 1) / 2
    n1, n2 = above.sum(), (~above).sum()
    runs, product = 1 + (above[1:] != above[:-1]).sum(), 2 * n1 * n2
    centred = digits - digits.mean()
    z = [(chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n), (runs - 1 - product / n) / math.sqrt(product * (product - n) / (n * n * (n - 1))),
         ((centred[1:] * centred[:-1]).sum() / (centred**2).sum() + 1 / n) * math.sqrt(n)]
    expected = 1 - (1 - min(math.erfc(abs(one) / math.sqrt(2)) for one in z)) ** 3
    found = spark.range(1).select(secrets.battery(F.lit(value), F.lit("0123456789abcdef"))).first()[0]
    assert abs(found - expected) < 1e-5


def test_fingerprints(spark, texts):
    found = {row.doc_id: row for row in QUERIES["op5_fingerprints"](spark, SMALL).collect()}
    order = sorted(texts)
    for doc, after in zip(order, [*order[1:], order[0]]):
        n = len(texts[doc])
        edited = texts[doc][:n - n // 4] + texts[after][:n // 4]
        assert found[doc].n_chars == n and found[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    same = Counter((texts[doc], found[doc].fingerprint) for doc in order)
    assert len(same) == len(set(texts.values())) == len({row.fingerprint for row in found.values()})
    assert np.mean([row.near_edited > row.near_next for row in found.values()]) > 0.95


def test_fingerprints_are_homomorphic(spark):
    rows = spark.createDataFrame([("a b\nc d e", "f g h.", "f g h.\nc d e\na b")], "a string, b string, c string")
    vectors = rows.select(*(fingerprints.fingerprint(F.col(name)).alias(name) for name in "abc"))
    a, b, c = (F.col(name) for name in "abc")
    assert vectors.select(fingerprints.inserted(a, b) == c, fingerprints.deleted(c, b) == a, fingerprints.deleted(c, a) == b).first() == (True, True, True)


def test_orc(spark, texts):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for row in QUERIES["op6_orc_tokens"](spark, SMALL).orderBy("doc_id").collect():
        ids = whole.encode(texts[row.doc_id], add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_orc_prunes(spark, tmp_path):
    path = (tmp_path / "orc").as_uri()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    orc_tokens.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    read = orc_tokens.read_tokens(spark, path).where("doc_id = 77")
    assert "EqualTo(doc_id,77)" in read._jdf.queryExecution().executedPlan().toString() and read.count() == 1


def test_languages_on_held_out_rows(spark):
    langs = {row.doc_id: row.lang for row in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang").collect()}
    found = QUERIES["op7_language_id"](spark, MORE).collect()
    held = [row for row in found if zlib.crc32(str(row.doc_id).encode()) % 3 == 1]
    assert all(row.held_out for row in held) and np.mean([row.lang_pred == langs[row.doc_id] for row in held]) > 0.97


def test_network_gradients():
    options = language_id.TrainOptions(window=12, embedding=3, filters=4)
    network = language_id.ByteNetwork(["a", "b"], options)
    network.values = {name: value.astype(np.float64) for name, value in network.values.items()}
    rng = np.random.default_rng(3)
    windows, target = rng.integers(97, 105, (6, 12)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        return -np.log(network.probabilities(windows, network.tables())[np.arange(6), target].astype(float)).mean()

    slopes = network.gradients(windows, target)
    for name, at in (("out", (1, 0)), ("bias", (1,)), ("w3", (4, 2)), ("b2", (1,)), ("embedding", (100, 1))):
        kept = network.values[name][at]
        network.values[name][at] = kept + 1e-2
        up = loss()
        network.values[name][at] = kept - 1e-2
        down = loss()
        network.values[name][at] = kept
        assert abs((up - down) / 2e-2 - slopes[name][at]) < 2e-3, name


def check_packing(rows, documents, capacity=2048):
    at = {}
    for row in sorted(rows, key=lambda row: (row.sequence_id, row.offset)):
        assert row.offset == at.get(row.sequence_id, 0)
        at[row.sequence_id] = row.offset + row.length
    assert max(at.values()) <= capacity
    by_doc = {}
    for row in sorted(rows, key=lambda row: (row.doc_id, row.piece)):
        assert row.start == by_doc.get(row.doc_id, 0)
        by_doc[row.doc_id] = row.start + row.length
    assert set(by_doc) == set(documents)
    return len(at), -(-sum(at.values()) // capacity)


def test_packing(spark, texts):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op8_best_fit_packing"](spark, SMALL).collect()
    used, bound = check_packing(rows, texts)
    assert used <= bound + 3
    ids = {doc: np.array(whole.encode(text, add_special_tokens=False).ids + [0], "<u4") for doc, text in texts.items()}
    assert all(row.ids_crc32 == zlib.crc32(ids[row.doc_id][row.start:row.start + row.length].tobytes()) for row in rows)


def test_packing_plan_is_tight():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6.2, 0.8, 20_000).astype(int) + 1, 2048)
    hist = np.bincount(lengths, minlength=2049)
    plan = packing.packing_plan(hist)
    used = np.zeros(2049, np.int64)
    for pattern, count in plan:
        assert sum(length * times for length, times in pattern) <= 2048
        for length, times in pattern:
            used[length] += times * count
    assert (used == hist).all()
    assert sum(count for _, count in plan) <= math.ceil(lengths.sum() / 2048) * 1.001 + 2


def test_byte_bpe(spark, texts):
    import base64
    import tiktoken
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(RANKS, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in QUERIES["op10_byte_bpe"](spark, SMALL).collect():
        ids = whole.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    rng = random.Random(5)
    letters = " \n\t'sabcéß中\U0001F600 12.,!  ſK"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1000)] + ["a" * 3000, " " * 50, "", "\n"]
    ids, counts = byte_bpe.segment_memory(RANKS, public_tokenizers.PATTERN).ids(odd)
    for text, own in zip(odd, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == whole.encode_ordinary(text)


def test_library_ids():
    from tokenizers import Tokenizer

    from plaudit.llm.library_tokens import spaced_memory, word_memory
    rng = random.Random(6)
    letters = " \n\t'sabcéßÀİΣſ中\U0001F600 12.,!|#$  K<>\x1c\x85\xa0éµª"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["a" * 300, " " * 50, "", "\n", " a b\nc. | d"]
    for name, memory in (("word_bpe_49k.json", word_memory), ("byte_bpe_50k.json", spaced_memory)):
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        whole.encode_special_tokens = True
        ids, counts = memory(public_tokenizers.path(name)).ids(odd)
        for text, own in zip(odd, np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_library_special_tokens():
    """Texts that spell out special tokens, against the tokenizer as it is."""
    from tokenizers import Tokenizer

    from plaudit.llm.library_tokens import spaced_memory, word_memory
    rng = random.Random(10)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", " ", "\n", "one", "Two", "é", "中", ".", "\0"]
    odd = ["one <|endoftext|> two", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500))]
    for name, memory in (("word_bpe_49k.json", word_memory), ("byte_bpe_50k.json", spaced_memory)):
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        ids, counts = memory(public_tokenizers.path(name)).ids(odd)
        for text, own in zip(odd, np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_revisits(spark):
    rows = [(1, "http://www.A.com/x/?utm_source=q&b=2&a=1#f", 10, "response", '"e1"', None, {"Content-Type": "t", "X": "1"}, "d1"),
            (2, "https://a.com/x?a=1&b=2", 10, "revisit", 'W/"e1"', None, {"x": "2", "Content-Type": "u", "Connection": "c"}, None),
            (3, "https://a.com/x?a=1&b=2", 9, "revisit", '"e1"', None, None, None),
            (4, "http://a.com/x?a=1&b=2", 12, "response", None, "day", {"Y": "1"}, "d2"),
            (5, "http://a.com/x?a=1&b=2", 13, "revisit", '"e1"', "day", {}, None),
            (6, "http://a.com/x?a=1&b=2", 13, "revisit", '"e1"', "other", {}, None),
            (7, "http://a.com/x?a=1&b=2", 13, "revisit", '"e1"', None, {}, None),
            (8, None, 13, "revisit", '"e1"', None, {}, None), (9, "http://a.com/x?a=1&b=2", None, "revisit", '"e1"', None, {}, None)]
    captures = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, "
                                           "headers map<string,string>, digest string")
    found = {row.record_id: row for row in revisits.resolved(spark, captures).collect()}
    assert (found[2].response_id, found[2].verdict, found[2].headers, found[2].digest) == (1, "resolved", {"content-type": "t", "x": "2"}, "d1")
    assert {at: found[at].verdict for at in (3, 5, 6, 7, 8, 9)} == {3: "no_response", 5: "resolved", 6: "mismatch", 7: "no_validator",
                                                                      8: "no_response", 9: "no_response"}
    payload = spark.createDataFrame([(1, "body")], "record_id long, payload string")
    assert [row.payload for row in revisits.with_payload(revisits.resolved(spark, captures), payload).collect()] == ["body"]


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({row.doc_id: row.text for row in docs.select("doc_id", "text").collect()})
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    classified, ruled, single, clean = kept
    assert set(texts) > set(classified) >= set(ruled) > set(single) == set(clean)
    sets = {doc: set(zip(*(text.split()[at:] for at in range(5)))) for doc, text in ruled.items()}
    for doc in set(ruled) - set(single):  # gone for a document of lesser id that is near, directly or by way of others
        assert any(other != doc and len(sets[doc] & own) >= 0.8 * len(sets[doc] | own) for other, own in sets.items())
    assert len({frozenset(sets[doc]) for doc in single}) == len(single)
    assert all(("[SECRET]" in clean[doc]) == bool(brute_spans(single[doc])) or clean[doc] != single[doc] for doc in clean)
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect(), clean)
