import re

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from llm.conftest import ODD, frame, prose
from llm.test_bpe import KNOWN
from llm.test_exact_dedup import brute as equal_texts
from llm.test_mixing import brute_targets
from llm.test_quality_rules import brute_verdicts
from llm.test_simhash import brute_print, brute_roots
from nearhome.session import written

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    long = prose(7, 600).split()
    rows = [(i, prose(i, 40), "abc"[i % 3]) for i in range(60)] + [(100 + i, prose(i, 40) + " ", "b") for i in range(20)]
    rows += [(200 + i, " ".join(long[:i] + ["changed"] + long[i + 1 :]), "c") for i in range(30)]
    rows += [(300 + i, "word " * 50, "a") for i in range(5)]
    return rows + ODD


def test_stages_against_brute_force(spark, folder):
    rows = corpus()
    labels = [(i, 1, 0) for i in range(0, 60, 2)]
    path = folder(documents=frame(spark, rows), labels=spark.createDataFrame(labels, LABELS))
    docs, stage = spark.read.parquet(path + "/documents.parquet"), dict(corpus_pipeline.STAGES)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "simhash near-dedup", "source mix", "byte-level BPE"]
    step = lambda name, docs: written(stage[name](spark, docs, path), "test-stage")
    content = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]

    good = step(names[0], docs)
    assert good.columns == docs.columns
    verdicts = brute_verdicts([(i, t) for i, t, _ in rows], {i for i, *_ in labels})
    assert sorted(str(i) for i, *_ in content(good)) == sorted(str(i) for i, _, kept in verdicts if kept)

    unique = step(names[1], good)
    groups = equal_texts(content(good))
    assert sorted(re.sub(r"[\x20\x09-\x0D]", "", t) for _, t, _ in content(unique)) == sorted(groups)
    assert {str(i) for i, *_ in content(unique)} == {str(i) for i, _ in groups.values()}

    apart, before = step(names[2], unique), content(unique)
    lowest = {}
    for (i, *_), root in zip(before, brute_roots([brute_print(t) for _, t, _ in before])):
        lowest[root] = min((x for x in (lowest.get(root), i) if x is not None), default=None)
    assert sorted(str(i) for i, *_ in content(apart)) == sorted(map(str, lowest.values()))

    mixed = step(names[3], apart)
    sizes, words, largest = {}, {}, {}
    for _, t, s in content(apart):
        sizes[s] = sizes.get(s, 0) + len(t.split())
        largest[s] = max(largest.get(s, 0), len(t.split()))
    for _, t, s in content(mixed):
        words[s] = words.get(s, 0) + len(t.split())
    assert mixed.columns == docs.columns
    assert all(abs(words.get(s, 0) - target) <= largest[s] for s, target in brute_targets(sizes).items())

    tokens = stage[names[4]](spark, mixed, path).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokens) == sorted((str(i), len(KNOWN.encode_ordinary(t))) for i, t, _ in content(mixed))

    run = corpus_pipeline.run(spark, path)
    assert sorted(map(str, run.collect())) == sorted(map(str, tokens))


def test_empty_tables(spark, folder, none):
    path = folder(documents=none, labels=spark.createDataFrame([], LABELS))
    assert corpus_pipeline.run(spark, path).count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_is_registered(n):
    assert len([name for name in entry_point.queries() if name.startswith(f"op{n}_")]) == 1
    assert entry_point.queries()["pipeline"] is corpus_pipeline.run
