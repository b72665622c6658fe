from collections import Counter

from tidemark.llm import stages
from tidemark.llm.mixing import mix


def test_rows_that_share_id_and_size(spark, folder):
    """Ids are shared or null and all texts have one size: what comes out of each source is what the mix decided."""
    rows = [(i % 2 if i % 3 else None, f"word {i} of four", "en", f"src{i % 5 % 3}", 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    took = Counter()
    for r in mix(docs, carry=True).collect():
        took[r["_row"]["source"]] += r["taken"]
    goals = Counter()
    for r in stages.mixing(spark, docs, folder).collect():
        goals[r["source"]] += 4
    assert +goals == +took and sum(goals.values()) == sum(r["taken"] for r in mix(docs).collect())
    most = Counter(r["text"] for r in stages.mixing(spark, docs, folder).collect())
    assert max(most.values()) <= 2
