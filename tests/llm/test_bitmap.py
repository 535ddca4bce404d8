from treillis.llm import bitmap


def test_keeps_all_that_are_asked_for(spark, monkeypatch):
    rows = spark.createDataFrame([(k if k else None, f"t{k}") for k in range(300)], "id bigint, _bits string")
    asked = spark.createDataFrame([(k,) for k in range(1, 300, 17)] + [(None,)], "cle bigint")
    want = {k for k in range(1, 300, 17)} | {None}
    got = [r["id"] for r in bitmap.maybe_in(rows, "id", asked, "cle").collect()]
    assert want <= set(got) and len(got) == len(set(got)) < 30
    monkeypatch.setattr(bitmap, "BITMAP", 6)
    assert want <= {r["id"] for r in bitmap.maybe_in(rows, "id", asked, "cle").collect()}
    assert bitmap.maybe_in(rows, "id", asked.limit(0), "cle").count() == 0
