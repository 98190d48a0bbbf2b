"""op2 deletes repeated runs in rows without an id too; null ids come first and are the origins."""

from gridloom.llm import op2_line_suffix


def test_repeated_run_in_null_id_rows(spark):
    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    rows = [(None, "first head\n" + run), (None, "second head\n" + run), (5, "third head\n" + run)]
    out = op2_line_suffix.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 3
    assert [r.n_removed for r in out if r.doc_id == 5] == [4]
    assert sorted(r.n_removed for r in out if r.doc_id is None) == [0, 4]
