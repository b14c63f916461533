import pytest

from pulsegrid.operators.access import acl_audit

LOG = "n int, username string, clientid string, action string, topic string"
LIST = "id long, username string, permission string, topic string, action string"


def audited(spark, log, access, columns=LIST):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(log)], LOG)
    return [r.allowed for r in acl_audit(rows, spark.createDataFrame(access, columns)).orderBy("n").collect()]


def test_order_and_denials_decide(spark):
    access = [
        (1, "a", "all", "x/secret", "deny"),
        (2, "a", "all", "x/#", "allow"),
        (3, "$all", "publish", "x/open", None),
        (4, "$all", "publish", "y/+/z", "allow"),
        (4, "$all", "publish", "y/1/z", "DENY"),
        (None, "b", "subscribe", "q", "allow"),
    ]
    log = [
        ("a", "c", "publish", "x/secret"),
        ("a", "c", "subscribe", "x/other/deep"),
        ("a", "c", "subscribe", "x"),
        ("b", "c", "publish", "x/open"),
        ("b", "c", "subscribe", "x/open"),
        ("b", None, "publish", "y/2/z"),
        (None, None, "publish", "y/1/z"),
        (None, None, "publish", "x/open"),
        ("b", None, "subscribe", "q"),
        ("b", "c", None, "q"),
        ("b", "c", "publish", None),
    ]
    want = [False, True, True, True, False, True, False, True, True, False, False]
    assert audited(spark, log, access) == want


def test_placeholders_name_levels_and_parts_of_them(spark):
    access = [(1, "$all", "all", "u/%u/%c", "allow"), (2, "$all", "all", "dev-%c/%u-x/#", "allow")]
    log = [
        ("a", "c", "publish", "u/a/c"),
        ("a", "c", "publish", "u/c/a"),
        ("+", "#", "publish", "u/b/c"),
        ("a", None, "publish", "u/a/c"),
        ("a", "c", "subscribe", "dev-c/a-x/1/2"),
        ("a", "c", "subscribe", "dev-c/b-x/1"),
    ]
    assert audited(spark, log, access) == [True, False, False, False, True, False]


def test_without_action_and_order(spark):
    access = [("a", "publish", "t")]
    log = [("a", None, "publish", "t"), ("a", None, "subscribe", "t")]
    assert audited(spark, log, access, "username string, permission string, topic string") == [True, False]
    assert audited(spark, log, [], "username string, permission string, topic string") == [False, False]


def test_large_lists_are_joined_by_equality(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        access = spark.range(50).selectExpr("'u' || id AS username", "'all' AS permission", "'t/' || id || '/#' AS topic")
        log = spark.range(50).selectExpr("id AS n", "'u' || id AS username", "'c' AS clientid", "'publish' AS action", "'t/' || id || '/x' AS topic")
        found = acl_audit(log, access)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert found.where("allowed").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("topic", ["", "/", "a//b"])
def test_empty_levels_are_levels(spark, topic):
    assert audited(spark, [("a", None, "publish", topic)], [(1, "a", "all", topic, None)]) == [True]
