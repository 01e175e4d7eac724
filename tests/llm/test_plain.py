"""Plain second versions of the operators' inner steps, and cases of shape: other tokenizers, clashing names, trees of several levels."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netcask.llm import common, packing, quality, shards, simhash, substrings
from tests.llm.test_llm import docs_of, edge_rows, plain_removed


@pytest.mark.parametrize("spare", [2, 3, 4, 5])
def test_keys_lose_no_pair(spare):
    r = np.random.default_rng(spare)
    masks = simhash.block_masks(4, spare)
    assert len(masks) == math.comb(4 + spare, spare)
    for _ in range(300):
        a = int(r.integers(0, 2**64, dtype=np.uint64))
        b = a
        for bit in r.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for m in masks)
    assert simhash.spare_blocks(10**6, 4) == 2 and simhash.spare_blocks(10**9, 4) == 3 and simhash.spare_blocks(10**12, 4) == 5


def test_longer_keys_find_the_same(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 20).tolist()
    fps = sorted({b ^ (1 << int(r.integers(0, 60))) ^ (1 << int(r.integers(0, 60))) for b in base for _ in range(4)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from netcask.llm.components import components

    found = [{(x["node"], x["root"]) for x in components(simhash.links(df, spare=s)).collect()} for s in (2, 3)]
    assert found[0] == found[1] and found[0]


def plain_differencing(sizes, n):
    """Sums of the parts, by lists."""
    held = [([s] + [0] * (n - 1), k) for k, s in enumerate(sizes)]
    fresh = len(held)
    while len(held) > 1:
        held.sort(key=lambda x: (-(x[0][0] - x[0][-1]), x[1]))
        (a, _), (b, _) = held[:2]
        held = [*held[2:], (sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), fresh)]
        fresh += 1
    return held[0][0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(2, 7))
def test_differencing_is_the_plain_one(sizes, n):
    part = shards.differ_sizes(np.array(sizes, np.int64), n)
    assert sorted(np.bincount(part, weights=sizes, minlength=n).astype(int).tolist(), reverse=True) == plain_differencing(sizes, n)


def test_differencing_beats_greedy():
    sizes = np.array([8, 7, 6, 5, 4])  # dealing each to the smaller part gives 17 to 13
    assert sorted(np.bincount(shards.differ_sizes(sizes, 2), weights=sizes).tolist()) == [14, 16]


def test_tree_of_tuples(spark):
    r = np.random.default_rng(2)
    rows = [(t, p, int(r.integers(1, 1000))) for t in range(23) for p in range(4) if r.random() < 0.9]
    plan = {(x["task"], x["part"]): x["shard"] for x in shards.merge_tree(spark.createDataFrame(rows, "task long, part int, bytes long"), 4, 23, fan=3).collect()}
    assert set(plan) == {(t, p) for t, p, _ in rows}
    sums = np.zeros(4)
    for t in range(23):
        mine = [plan[t, p] for p in range(4) if (t, p) in plan]
        assert len(set(mine)) == len(mine)  # parts of one tuple stay apart
    for t, p, size in rows:
        sums[plan[t, p]] += size
    assert sums.max() - sums.min() < 200


def test_shards_are_even_but_for_a_great_group(spark):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(1000 + i, "y" * 900) for i in range(200)]
    sums, sizes = Counter(), Counter()
    for x in shards.shard_documents(docs_of(spark, rows), 4).collect():
        sums[x["shard"]] += x["size"]
        sizes[x["shard"], x["text_crc32"]] += x["size"]
    great = next(s for s, crc in sizes if crc == zlib.crc32(b"y" * 900))
    rest = [v for s, v in sums.items() if s != great]
    assert sums[great] == 200 * 908 and max(rest) - min(rest) <= 8 * 58


def test_another_tokenizer(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    rows = [(1, "Don't  SHOUT <|x|> é"), (2, None), (3, " a\n\nb ")]
    got = {(x["doc_id"], x["length"], x["ids_crc32"]) for x in packing.pack_documents(docs_of(spark, rows), tokenizer_path=path).collect()}
    want = set()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.add((i, len(ids), zlib.crc32(ids.tobytes())))
    assert got == want
    assert not packing.splits_at_space(path) and packing.splits_at_space(str(public_tokenizers.path("word_bpe_49k.json")))


def test_as_few_bins_as_lengths_allow():
    sizes = np.minimum(np.random.default_rng(3).lognormal(6, 1, 4000).astype(np.int64) + 1, 4096)
    bin_of, _ = packing.pack(sizes)
    assert bin_of.max() + 1 <= -(-sizes.sum() // 4096) + 1


def plain_score(model, text):
    """A score from the text by loops over bytes, passages and units."""
    p = model.p
    logits, hidden = [], []
    for at in range(0, max(len(text), 1), 512):
        part = text[at : at + 512]
        x = [0] * quality.WIDTH
        for i, c in enumerate(part):
            x[quality._FOLD[c]] += 1
            if i:
                x[quality._PAIR[quality._FOLD[part[i - 1]] * quality.CLASSES + quality._FOLD[c]]] += 1
        x = [round(255 * math.sqrt(n / len(part))) / 255 if n else 0.0 for n in x]
        h = [math.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x)) if x[i]) + p["c"][j]) for j in range(quality.HIDDEN)]
        e = 0.0
        for k in range(quality.GATE):
            t, s = (sum(h[j] * p[m][j, k] for j in range(len(h))) for m in ("V", "U"))
            e += p["w"][k] * math.tanh(t) / (1 + math.exp(-s))
        logits.append(e)
        hidden.append(h)
    a = [math.exp(e - max(logits)) for e in logits]
    z = [sum(w * h[j] for w, h in zip(a, hidden, strict=True)) / sum(a) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(o * v for o, v in zip(p["o"], z, strict=True)) - p["b"][0]))


@pytest.mark.parametrize("text", ["", "a", "Some words, été 42!! " * 90, "x" * 1025])
def test_scores_are_the_plain_ones(text):
    model = quality.Attention()
    assert model.score(text.encode()) == pytest.approx(plain_score(model, text.encode()), abs=1e-5)


def test_quality_of_edge_rows(spark):
    rows = [*edge_rows(), (None, "again"), (None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0)], "doc_id long, quality int")
    out = quality.quality_scores(docs_of(spark, rows), labels).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(i for i, _ in rows)
    assert all(0 <= x["score"] <= 1 for x in out) and not any(x["held_out"] for x in out if x["doc_id"] is None)


def test_repeats_where_names_clash(spark):
    passage = "".join(chr(97 + i * i % 26) for i in range(260))
    texts = [passage + "one", "two" + passage, "nothing"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "tid long, text string, n_bytes int")
    got = {x["tid"]: x["n_removed"] for x in substrings.remove_repeats(df, "tid").collect()}
    assert got == {i: w[1] for i, w in enumerate(plain_removed([t.encode() for t in texts]))}
    assert substrings.remove_repeats(df.withColumnRenamed("tid", "k"), "n_bytes").count() == 3
    assert substrings.drop_repeats(df).columns == df.columns


def test_tables_leave_the_catalog(spark):
    kept = list(common._written), list(common._tables)
    common._written.clear(), common._tables.clear()
    common.bucketed_table(spark.range(10), "test-table", 2, "id")
    name = common._tables[0][1]
    assert spark.catalog.tableExists(name)
    common.drop_written()
    assert not spark.catalog.tableExists(name)
    common._written.extend(kept[0]), common._tables.extend(kept[1])


def test_no_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session())


def test_repeats_are_the_plain_ones_for_a_common_core(spark):
    r = np.random.default_rng(8)
    core = "".join(map(chr, r.integers(97, 123, 170)))
    texts = ["".join(map(chr, r.integers(97, 100, int(n)))) + core + "".join(map(chr, r.integers(97, 99, int(m)))) for n, m in r.integers(0, 80, (60, 2))]
    for group in (1000, 20):
        got = {x["doc_id"]: x["n_removed"] for x in substrings.remove_repeats(docs_of(spark, list(enumerate(texts))), group=group).collect()}
        assert got == {i: w[1] for i, w in enumerate(plain_removed([t.encode() for t in texts]))}


def test_pipeline_with_nulls_and_clashing_names(spark, sf):
    import corpus_pipeline as p

    good = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = [(None, None, None, None, None), (7001, "", "en", "a", 0), (7002, None, "en", None, None), (7001, "", "en", "a", 0), (None, "word " * 30000, None, "b", 150000)]
    docs = good.unionByName(spark.createDataFrame(rows, good.schema))
    clash = {c: "x" for c in ("tid", "bag", "starts", "fp", "component_id", "score", "b", "id", "_nc_text", "n_bytes", "kind")}
    docs = docs.selectExpr("*", *[f"'{v}' AS {c}" for c, v in clash.items()])
    for _, stage in p.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        docs = common.materialize(made, "test")
        assert {r[0] for r in docs.select("tid").distinct().collect()} <= {"x"}
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == docs.count()
    none = docs.limit(0)
    for _, stage in p.STAGES[:-1]:
        none = common.materialize(stage(spark, none, sf), "test")
        assert none.columns == docs.columns and none.count() == 0
    assert p.STAGES[-1][1](spark, none, sf).count() == 0
