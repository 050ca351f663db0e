"""Byte-range readers against the plain ones, for ranges that cut fields, records and objects everywhere."""
import csv
import json
import random

import pytest

from varilens.sources import ranges, readers, writers

SCHEMA = "id long, x string, y string, z double"


@pytest.fixture
def sized(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    spark.conf.set(names[1], "0")
    spark.conf.set(names[2], "1")
    yield lambda n: spark.conf.set(names[0], str(n))
    for n in names:
        spark.conf.unset(n)


def _cell(rnd):
    return rnd.choice(['plain', 'a,b', 'q"uote', 'multi\nline\ntext', '"', '""', '\n', 'x' * rnd.randint(0, 300), '', 'tail\n"q"\n', ' sp ',
                       '\n' * 40, '😀é'])


def _rows(df):
    return sorted(map(str, df.collect()))


def _plain_csv(spark, path):
    return spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _plain_json(spark, path):
    return spark.read.schema(readers.LINK_INDEX_SCHEMA).option("multiLine", True).json(path)


@pytest.mark.parametrize("size, end", [(500, "\n"), (4000, "\r\n"), (10**7, "\n")])
def test_csv_equals_the_plain_reader(spark, scratch, sized, size, end):
    rnd = random.Random(size)
    for k in range(3):  # the last file is a header alone
        with open(f"{scratch}/{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "x", "y", "z"])
            w.writerows([i, _cell(rnd), _cell(rnd), rnd.random()] for i in range((600, 50, 0)[k]))
    sized(size)
    got, want = readers.load_csv(spark, scratch, _plain_csv(spark, scratch).schema), _plain_csv(spark, scratch)
    assert _rows(got) == _rows(want)
    if size == 500:
        assert spark.read.text(scratch).rdd.getNumPartitions() > 30


def test_a_record_over_many_ranges(spark, scratch, sized):
    big = "line\n" * 2000
    with open(f"{scratch}/a.csv", "w", newline="") as f:
        csv.writer(f).writerows([["id", "x", "y", "z"], [1, big, "a", 1.5], [2, "b", big + '"', 2.5], [3, "c", "d", 3.5]])
    sized(300)
    got = sorted((r.id, r.x, r.y, r.z) for r in readers.load_csv(spark, f"{scratch}/a.csv", _plain_csv(spark, scratch).schema).collect())
    assert got == [(1, big, "a", 1.5), (2, "b", big + '"', 2.5), (3, "c", "d", 3.5)]


def test_csv_types_from_values(spark, scratch):
    with open(f"{scratch}/a.csv", "w") as f:
        f.write('n,d,b,s,e\n1,1.5,true,x,\n-2,3,False,"y\nz",\n,,,,\n')
    df = readers.load(spark, f"{scratch}/a.csv")
    assert dict(df.dtypes) == {"n": "bigint", "d": "double", "b": "boolean", "s": "string", "e": "bigint"} or dict(df.dtypes)["e"] == "string"
    assert [tuple(r)[:4] for r in df.collect()] == [(1, 1.5, True, "x"), (-2, 3.0, False, "y\nz"), (None, None, None, None)]


@pytest.mark.parametrize("size", [300, 5000, 10**7])
@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_json_array_equals_the_plain_reader(spark, scratch, sized, size, layout):
    rnd = random.Random(size)
    odd = ["}", "{", "]", "a\\", '"}', "é😀", '\\"}{"', "\n}\n", "}" * 700]
    for k, n in enumerate((400, 1, 0)):
        objects = [{"id": i, "link": _cell(rnd) + '{}[]\\"', "publication_year": None, "answer_idx": "A", "answer": rnd.choice(odd)} for i in range(n)]
        with open(f"{scratch}/{k}.json", "w") as f:
            json.dump(objects, f, ensure_ascii=bool(k), **layout)
    sized(size)
    assert _rows(readers.read_link_index(spark, scratch)) == _rows(_plain_json(spark, scratch))


def test_nested_objects_stay_whole(spark, scratch, sized):
    objects = [{"id": i, "tags": [{"a": {"b": i}}] * (i % 5)} for i in range(200)]
    with open(f"{scratch}/a.json", "w") as f:
        json.dump(objects, f, indent=1)
    sized(100)
    got = ranges.read_json_array(spark, scratch, "id long, tags array<struct<a:struct<b:long>>>").collect()
    assert sorted((r.id, len(r.tags)) for r in got) == [(i, i % 5) for i in range(200)]
    assert all(t.a.b == r.id for r in got for t in r.tags)


def test_written_arrays_read_back(spark, scratch):
    df = spark.createDataFrame([(i, f"u{{{i}}}", None, "A", 'x"}') for i in range(50)], readers.LINK_INDEX_SCHEMA).repartition(4)
    writers.write_json_array(df.unionAll(df.limit(0)), f"{scratch}/links")
    assert _rows(readers.read_link_index(spark, f"{scratch}/links")) == _rows(df)
    for name in ("links",):
        import glob
        assert sum(len(json.load(open(p))) for p in glob.glob(f"{scratch}/{name}/*.txt")) == 50
