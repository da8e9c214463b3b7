import corpus_pipeline as cp
import public_tokenizers
import sentencepiece
from tests.llm import brute

from lexstrata.llm.common import Scratch, read

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    scratch, docs = Scratch(spark), read(spark, SF, "documents")
    got = []
    for name, stage in cp.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, SF), "stage")
        assert tuple(docs.columns) == cp.COLUMNS
        got.append({r.doc_id: r for r in docs.collect()} if name != "source mix" else docs.collect())
    first, lines, near, mixed = got
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    kept = sum(i in first for i in good) / len(good)
    assert kept > 0.9, kept
    assert set(lines) <= set(first) and set(near) <= set(lines)
    want = brute.op3([(i, r.text) for i, r in lines.items()])
    assert set(near) == {i for i, (_, c) in want.items() if i == c}
    size = lambda t: len(brute.WORD.findall(t or ""))
    total = sum(size(r.text) for r in near.values())
    assert abs(sum(size(r.text) for r in mixed) - 1.5 * total) <= 20
    assert all((near[r.doc_id].text or "").startswith(r.text or "") for r in mixed)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = sorted((r.doc_id, sp.encode(r.text)) for r in mixed)
    assert sorted((r.doc_id, list(r.ids)) for r in cp.STAGES[-1][1](spark, docs, SF).collect()) == texts


def test_stages_take_odd_rows(spark):
    """Nulls, empties, repeats, a very long text and clashing names, stage by stage, and no rows at all."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None, None, None, None), (None, words + " null", "en", "a", 3), (2, "", "en", "a", 0), (3, words, "en", "a", 0), (3, words, "en", "a", 0), (4, words + " end", "en", None, 1), (5, " ".join(f"x{k}" for k in range(40_000)), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(cp.STAGES)

    def ids(name, given):
        wide = given.selectExpr("*", "text AS rule", "doc_id AS root", "source AS kept", "text AS gone", "doc_id AS taken")
        return sorted((r.doc_id for r in stages[name](spark, wide, SF).collect()), key=str)

    assert set(ids("quality rules", docs)) <= {None, 3, 4, 5} and not {1, 2} & set(ids("quality rules", docs))  # base failures go
    assert ids("line dedup", docs) == sorted((r[0] for r in rows), key=str)  # no line is on five sites
    assert ids("near duplicates", docs) == sorted([1, None, 2, 3, 3, 5], key=str)  # 4 goes with 3; rows of one document stay; what has no id or no words links nothing
    mixed = ids("source mix", docs)
    assert set(mixed) <= {None, 3, 4, 5} and mixed.count(5) <= 2  # what has no words gives nothing
    got = {(r.doc_id, r.n_tokens == 0) for r in stages["sentencepiece"](spark, docs, SF).collect()}
    assert got == {(1, True), (2, True), (None, False), (3, False), (4, False), (5, False)}
    for name in stages:
        assert ids(name, docs.limit(0)) == []
