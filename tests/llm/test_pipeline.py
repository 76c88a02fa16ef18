"""The pipeline's stages on small tables with nulls, empty, long and repeated texts, and clashing column names."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
EXTRA = ["score", "x", "_w", "_c", "_t", "n_words", "n_hit", "contaminated", "key", "row", "_before", "predicted", "held_out", "text_hash", "root", "node", "spans"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("aeioubcdfghlmnprst"), rng.integers(2, 9))) for _ in range(n))


def rows():
    rng = np.random.default_rng(14)
    good = [prose(rng, 3000 if i % 6 == 5 else 80) for i in range(60)]
    junk = [" ".join("".join(rng.choice(list("XYZ!%&$#"), 6)) for _ in range(60)) for _ in range(40)]
    passage = " ".join(f"item{i}" for i in range(30))
    texts = [*good, *junk]
    texts += [good[0], good[1].replace(good[1].split()[40], "changed", 1), f"{good[2]} {passage}", f"{prose(rng, 3000)} {passage}", f'{good[3]} token = "0123456789abcdef0123456789abcdef"', "", None, " \n ", prose(rng, 30_000)]
    out = list(enumerate(texts))
    return [*out, out[5], (None, good[6] + " and more words here"), (None, None)], passage


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    some, passage = rows()
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *[7] * len(EXTRA)) for i, t in some], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, some, passage


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def near(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words(a), words(b)))
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("name", list(STAGES)[:4])
def test_stages_keep_columns_and_clean_rows(spark, tables, name):
    folder, some, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = STAGES[name](spark, docs, folder)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    empty = STAGES[name](spark, docs.limit(0), folder)
    assert (empty.columns, empty.count()) == (docs.columns, 0)
    if name == "quality classifier":
        ids = [d for d, _ in left if d is not None]
        assert len({d for d in ids if d < 60}) >= 57
        assert sum(60 <= d < 100 for d in ids) <= 2
    elif name == "near-duplicates":
        kept = [t for _, t in left]
        assert set(left) <= set(some)
        assert not any(near(a, b) for a, b in itertools.combinations(kept, 2))
        assert all(any(near(t, k) for k in kept) for _, t in some if words(t))  # of each group one stays
        assert {(d, t) for d, t in some if not words(t)} <= set(left)
    elif name == "benchmark decontamination":
        bad = lambda t: passage in (t or "") and 20 * 30 >= len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()))
        assert sorted(map(repr, left)) == sorted(repr(x) for x in some if not bad(x[1]))
    else:
        assert len(left) == len(some)
        assert not any("0123456789abcdef" in (t or "") for _, t in left)
        before = {d: t for d, t in some}
        changed = [d for d, t in left if d is not None and before[d] != t]
        assert changed == [104]
        rows_ = {r.doc_id: r for r in got.where("doc_id = 104 or doc_id = 106").collect()}
        assert rows_[104].n_chars == len(rows_[104].text)
        assert rows_[106].n_chars is None


def test_whole_pipeline(spark, tables):
    folder, some, passage = tables
    got = corpus_pipeline.run(spark, folder)
    rows_ = got.collect()
    ids = [r.doc_id for r in rows_ if r.piece == 0]
    assert len(ids) == len(set(ids))
    assert {0, 2, 3} <= set(ids) and not {100, 101, 102} & set(ids)  # copies and a contaminated one go, what they copy stays
    assert 103 in ids  # a passage in a long text is no contamination
    assert sum(r.length for r in rows_) / 4096 <= len({r.sequence_id for r in rows_}) <= sum(r.length for r in rows_) / 4096 + 2
