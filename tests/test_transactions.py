import threading

import pytest

from stratakeep.engine import Engine
from stratakeep.errors import AnalysisError, TxConflict, TxDone


@pytest.fixture
def db(spark, tmp_path):
    db = Engine(spark, f"file://{tmp_path}/db")
    db.sql("create table t (k int64, v string, primary key (k));")
    db.insert_df("t", spark.createDataFrame([(i, "a") for i in range(4)], "k long, v string"))
    return db


def rows(source):
    return source.sql("select k, v from t;").rows()


def test_snapshot_and_own_writes(db):
    with db.transaction() as tx:
        db.sql("update t set v = 'other' where k = 3;")
        tx.sql("insert into t values (9, 'mine');")
        tx.sql("delete from t where k = 0;")
        assert rows(tx) == [(1, "a"), (2, "a"), (3, "a"), (9, "mine")]
        assert rows(db) == [(0, "a"), (1, "a"), (2, "a"), (3, "other")]
    assert rows(db) == [(1, "a"), (2, "a"), (3, "other"), (9, "mine")]


def test_conflict_on_the_same_key_only(db):
    one, two, three = db.transaction(), db.transaction(), db.transaction()
    one.sql("update t set v = '1' where k = 1;")
    two.sql("delete from t where k = 1;")
    three.sql("update t set v = '3' where k = 2;")
    one.commit()
    three.commit()
    with pytest.raises(TxConflict):
        two.commit()
    assert rows(db) == [(0, "a"), (1, "1"), (2, "3"), (3, "a")]


def test_reads_never_conflict(db):
    tx = db.transaction()
    assert len(rows(tx)) == 4
    db.sql("delete from t;")
    tx.commit()
    assert rows(db) == []


def test_inserts_of_one_key_conflict(db):
    one, two = db.transaction(), db.transaction()
    one.sql("insert into t values (7, 'x');")
    two.sql("insert into t values (7, 'y');")
    two.commit()
    with pytest.raises(TxConflict):
        one.commit()


def test_tables_defined_meanwhile(db):
    one, two = db.transaction(), db.transaction()
    one.sql("insert into t values (7, 'x');")
    two.sql("drop table t;")
    two.commit()
    with pytest.raises(TxConflict):
        one.commit()
    one, two = db.transaction(), db.transaction()
    for tx in (one, two):
        tx.sql("create table t (a int64, primary key (a));")
    one.commit()
    with pytest.raises(TxConflict):
        two.commit()
    one, two = db.transaction(), db.transaction()
    one.sql("drop table t;")
    two.sql("insert into t values (1);")
    two.commit()
    with pytest.raises(TxConflict):
        one.commit()


def test_create_fill_and_drop_in_one(db):
    with db.transaction() as tx:
        tx.sql("create table u (a int64, primary key (a));")
        tx.sql("insert into u values (1);")
        tx.sql("drop table t;")
        tx.sql("create table t (b int64, primary key (b));")
        tx.sql("insert into t values (5);")
        tx.sql("create table w (a int64, primary key (a));")
        tx.sql("insert into w values (1);")
        tx.sql("drop table w;")
    assert db.sql("select * from u;").rows() == [(1,)] and db.sql("select * from t;").rows() == [(5,)] and db.tables() == ["t", "u"]


def test_nested(db):
    with db.transaction() as tx:
        with tx.begin() as inner:
            inner.sql("insert into t values (7, 'x');")
            deeper = inner.begin()
            deeper.sql("delete from t;")
            assert rows(deeper) == []
            deeper.abort()
            with inner.begin() as deepest:
                deepest.sql("delete from t where k < 2;")
        assert rows(tx) == [(2, "a"), (3, "a"), (7, "x")]
        assert len(rows(db)) == 4
    assert rows(db) == [(2, "a"), (3, "a"), (7, "x")]


def test_abort_and_finished(db):
    with pytest.raises(ZeroDivisionError), db.transaction() as tx:
        tx.sql("delete from t;")
        1 / 0
    assert len(rows(db)) == 4
    for call in (tx.commit, tx.abort, tx.begin, lambda: tx.sql("select k from t;")):
        with pytest.raises(TxDone):
            call()
    outer = db.transaction()
    inner = outer.begin()
    outer.abort()
    with pytest.raises(TxDone):
        inner.sql("select k from t;")


def test_failed_statement_leaves_nothing(db):
    with pytest.raises(AnalysisError):
        db.sql("update t set nothing = 1;")
    assert len(rows(db)) == 4


def test_compaction_beside_a_writer(db):
    tx = db.transaction()
    tx.sql("update t set v = 'z' where k = 0;")
    db.sql("delete from t where k = 3;")
    assert db.compact("t") == ["t"]
    tx.commit()
    assert rows(db) == [(0, "z"), (1, "a"), (2, "a")]
    assert db.compact("t") == ["t"] and db.compact("t") == [] and rows(db) == [(0, "z"), (1, "a"), (2, "a")]


def test_concurrent_increments(db):
    """Of transactions that race for one key, exactly the committed ones count."""
    db.sql("create table c (k int64, n int64, primary key (k));")
    db.sql("insert into c values (0, 0);")
    done = []

    def work():
        for _ in range(2):
            try:
                with db.transaction() as tx:
                    n = tx.select("c", [0])[1]
                    tx.update("c", [0, n + 1])
                done.append(1)
            except TxConflict:
                pass

    threads = [threading.Thread(target=work) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert db.select("c", [0])[1] == len(done) >= 1


def test_older_versions(db):
    before = db.storage.head().version
    db.sql("delete from t;")
    assert db.table("t", before).count() == 4 and db.table("t").count() == 0


def test_siblings_fold_onto_one_another(spark, tmp_path):
    db = Engine(spark, f"file://{tmp_path}/siblings")
    db.sql("create table t (k int64, v string, primary key (k));")
    with db.transaction() as tx:
        one, two, three = tx.begin(), tx.begin(), tx.begin()
        one.insert("t", [1, "one"])
        two.insert("t", [2, "two"])
        two.upsert("t", [1, "two"])
        assert one.select("t", [2]) is None and two.select("t", [1]) == (1, "two")
        one.commit()
        assert tx.table("t").count() == 1
        two.commit()  # the later commit's row stays
        assert sorted(map(tuple, tx.table("t").collect())) == [(1, "two"), (2, "two")]
        three.insert("t", [3, "three"])
        dropping = tx.begin()
        dropping.drop("t")
        dropping.commit()
        with pytest.raises(TxConflict):
            three.commit()
    assert "t" not in db.tables()
