import corpus_pipeline
import __spark_entry__ as entry
from tidemark.llm import queries
from tidemark.llm.mixing import mix
from tidemark.llm.secrets import scan
from tests.llm.test_similarity import share


def test_stages_against_brute_force(spark, docs, folder):
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "secrets", "mixing", "packing"]
    steps = dict(corpus_pipeline.STAGES)
    known = steps["language"](spark, docs, folder).cache()
    assert known.columns == columns
    with_letters = [r for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))]
    assert sorted(str(r["text"]) for r in known.collect()) == sorted(r["text"] for r in with_letters)
    single = steps["near_dedup"](spark, known, folder).cache()
    kept, all_ = ({(r["doc_id"], r["text"]) for r in t.where("doc_id IS NOT NULL").collect()} for t in (single, known))
    assert kept <= all_ and not [(a, b) for a, x in kept for b, y in kept if a < b and share(x, y) >= 0.8]
    assert all(any(b < a and share(x, y) >= 0.8 for b, y in all_) for a, x in all_ - kept)
    clean = steps["secrets"](spark, single, folder).cache()
    assert clean.count() == single.count() and not scan([r["text"] or "" for r in clean.collect()])
    mixed = steps["mixing"](spark, clean, folder).cache()
    assert mixed.columns == columns
    sizes = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert sizes(mixed) == sum(r["taken"] for r in mix(clean).collect())
    packed = steps["packing"](spark, mixed, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_every_operator_is_registered():
    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in queries.QUERIES}
    assert set(queries.QUERIES) <= set(found) and "pipeline" in found


def test_stages_keep_columns_of_any_name(spark, folder):
    """Extra columns with the operators' own names come out as they went in; ids are shared or missing."""
    names = ["_lang", "_lang_", "_hash", "_id", "id", "hash", "row", "size", "_size", "_row", "_s", "_copies", "taken", "key", "fp", "node"]
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(i % 3 if i % 4 else None, f"{words} and number {i}" if i % 5 else "twice the very same text here", "en", f"s{i % 2}", 5, *(f"{n}{i}" for n in names)) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        seen = {(r["text"], *r[5:]) for r in found.collect()}
        assert seen and seen <= {(r[1], *r[5:]) for r in rows}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_run_leaves_its_result_only(spark, folder):
    import os

    from tidemark.llm.common import shared_dir

    root = os.path.join(shared_dir(spark).removeprefix("file:"), "tidemark")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    found = corpus_pipeline.run(spark, folder)
    assert {x.split("-")[0] + "-" + x.split("-")[1] for x in set(os.listdir(root)) - before} == {"stage-packing"} and found.count() > 0
