import pytest

from tessera.plans.dag import CycleError, Step, levels
from tessera.plans.runner import ATTEMPTS, Blocked, Migration, backoff

DDL = """
CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25) NOT NULL, n_regionkey INT, FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey));
CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name VARCHAR(25), r_flag TINYINT UNSIGNED);
CREATE VIEW b AS SELECT * FROM a WHERE n > 1;
CREATE VIEW a AS SELECT r.r_name, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name;
"""


def sources(spark, orphan=False):
    tables = {
        "region": spark.createDataFrame([(i, f"R{i}", 300 if i == 2 else i) for i in range(4)], "r_regionkey int, r_name string, r_flag int"),
        "nation": spark.createDataFrame([(i, f"N{i}", 9 if orphan and i == 3 else i % 4) for i in range(10)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    return tables.__getitem__


def test_levels():
    got = levels([Step("a", ""), Step("b", "", needs={"a"}), Step("c", "", needs={"a"}), Step("d", "", needs={"b", "c"})])
    assert [[s.id for s in level] for level in got] == [["a"], ["b", "c"], ["d"]]
    with pytest.raises(CycleError):
        levels([Step("a", "", needs={"b"}), Step("b", "", needs={"a"})])


def test_backoff_grows_to_a_minute():
    assert 1.6 <= backoff(1) <= 2.4 and backoff(20) <= 72


def test_migration(spark, tmp_path):
    events = []
    m = Migration(spark, DDL, "mysql", sources(spark), str(tmp_path / "t"), state=str(tmp_path / "state"), on_event=lambda s, e: events.append((s, e)))
    assert m.run() == {"done": len(m.steps)}
    assert m.table("nation").count() == 10 and spark.table("b").count() == 4
    order = [s for s, e in events if e == "done"]
    assert order.index("create_view:a") < order.index("create_view:b") and order[-1] in ("create_view:b", "validate")
    again = Migration(spark, DDL, "mysql", sources(spark), str(tmp_path / "t"), state=str(tmp_path / "state"))
    again.replay("copy_table:nation")
    assert again.state.status["validate"] == "waiting" and again.state.status["copy_table:region"] == "done"
    assert again.run() == {"done": len(m.steps)} and again.table("nation").count() == 10


def test_orphans_fail_the_check(spark, tmp_path):
    m = Migration(spark, DDL, "mysql", sources(spark, orphan=True), str(tmp_path))
    assert m.run()["failed"] == 1 and "foreign" in m.state.info["check_foreign_keys:nation"]


def test_failures_are_tried_again(spark, tmp_path):
    good, calls = sources(spark), []

    def flaky(name):
        calls.append(name)
        if name == "region" and calls.count("region") < ATTEMPTS:
            raise OSError("gone")
        return good(name)

    m = Migration(spark, DDL, "mysql", flaky, str(tmp_path), sleep=lambda s: None)
    assert m.run() == {"done": len(m.steps)} and m.state.attempts["copy_table:region"] == ATTEMPTS


def test_dead_sources_stop_what_waits(spark, tmp_path):
    def dead(name):
        raise OSError("gone")

    m = Migration(spark, DDL, "mysql", dead, str(tmp_path), sleep=lambda s: None)
    got = m.run()
    assert got["failed"] == 2 and got["cancelled"] >= 4


def test_prerequisites_block(spark, tmp_path):
    ddl = DDL + "CREATE TRIGGER t AFTER INSERT ON nation FOR EACH ROW SET @a = 1;"
    m = Migration(spark, ddl, "mysql", sources(spark), str(tmp_path))
    with pytest.raises(Blocked):
        m.run()
    assert m.run(acknowledged={"t"})["done"]
    assert m.plan.report_frame(spark).where("kind = 'prerequisite'").count() == 1
