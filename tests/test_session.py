import os

from tessera.session import materialize, release, settled


def there(table):
    return os.path.exists(table._materialized_at.removeprefix("file://"))


def test_release(spark):
    one, other = materialize(spark.range(3), "one"), materialize(spark.range(4), "other")
    release(one, one, spark.range(2))
    assert not there(one) and there(other) and other.count() == 4


def test_settled_keeps_the_result_alone(spark):
    made = []

    def build():
        made.append(materialize(spark.range(5), "way"))
        inner = settled(lambda: made.append(materialize(made[0].where("id > 1"), "deep")) or made[1].where("id > 2"), "inner")
        made.append(inner)
        return inner.selectExpr("id + 1 AS id")

    out = settled(build, "out")
    assert sorted(r["id"] for r in out.collect()) == [4, 5]
    assert there(out) and not any(map(there, made))


def test_settled_after_a_failure(spark):
    made = []

    def build():
        made.append(materialize(spark.range(5), "way"))
        raise RuntimeError("stop")

    try:
        settled(build, "out")
    except RuntimeError:
        pass
    assert there(made[0])
    after = materialize(spark.range(1), "after")
    assert after.count() == 1 and there(after)
