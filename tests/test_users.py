import random

from csilake.operators import users

ORDER = ["at", "nr"]


def replay(base, log):
    """The table after each change in turn, and what each change met."""
    table = {r[0]: r[1:] for r in base}
    report = {}
    for uid, op, nome, apelido, status, at, nr in sorted(log, key=lambda c: (c[5], c[6])):
        met = op == "I" or uid in table
        if op in "IU" and met:
            table[uid] = (nome, apelido, status)
        elif op == "D" and met:
            del table[uid]
        applied, unmatched = report.get(op, (0, 0))
        report[op] = (applied + met, unmatched + (not met))
    return table, report


def logs(seed):
    rng = random.Random(seed)
    base = [(i, f"n{i}", f"a{i}", rng.randrange(3)) for i in range(1, 30)]
    log, inserted = [], {}
    for nr in range(400):
        at = nr // 3
        uid = 1 if rng.random() < 1 / 3 else rng.randrange(1, 60)
        op = rng.choices("UD", [20, 1])[0]
        if uid >= 40 and uid not in inserted:
            # Changes of an id that does not exist yet come before some of the inserts.
            op = rng.choice("IUD")
            if op == "I":
                inserted[uid] = True
        log.append((uid, op, f"x{nr}", f"y{nr}", rng.randrange(3), at, nr))
    return base, log


def test_apply_changes_equals_replay(spark):
    for seed in range(4):
        base, log = logs(seed)
        table, report = replay(base, log)
        b = spark.createDataFrame(base, "id bigint, nome string, apelido string, status int")
        c = spark.createDataFrame(log, "id bigint, op string, nome string, apelido string, status int, at int, nr int")
        found = {r["id"]: (r["nome"], r["apelido"], r["status"]) for r in users.apply_changes(b, c, ORDER).collect()}
        assert found == table
        counts = {r["op"]: (r["applied"], r["unmatched"]) for r in users.change_report(b, c, ORDER).collect()}
        assert counts == report


def test_validate(spark):
    rows = [(1, " Ana ", "a"), (2, "\t", "b"), (3, "Bo", None), (4, "", " ")]
    valid, rejects = users.validate(spark.createDataFrame(rows, "id int, nome string, apelido string"))
    assert [tuple(r) for r in valid.collect()] == [(1, "Ana", "a")]
    assert {r["id"]: r["missing"] for r in rejects.collect()} == {2: "nome", 3: "apelido", 4: "nome,apelido"}


def test_count_of_none(spark):
    empty = spark.createDataFrame([], "id bigint, nome string, apelido string, status int")
    assert tuple(users.count(empty).collect()[0]) == (0, True)
