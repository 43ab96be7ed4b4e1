"""Resolution of attribute references: every reason to refuse a product, and what is made."""

from deltaweave.operators import attributes

REFS = "id_product int, combination int, id_attribute int, group_key string, value_key string, group_name string, value string"


def resolved(spark, rows, auto_create=True, most=attributes.MOST_REFERENCES):
    refs = spark.createDataFrame(rows, REFS)
    mapping = spark.createDataFrame([("size", "s", 10), ("size", "m", 11)], "group_key string, value_key string, id_attribute int")
    available = spark.createDataFrame([(10,), (12,), (12,)], "id_attribute int")
    groups = spark.createDataFrame([(1, "Size", 4), (2, "Twice", 0), (3, "Twice", 1)], "id_group int, name string, position int")
    has = spark.createDataFrame([(10, 1, "S", 0), (11, 1, "M", 1), (12, 1, "L", 7)], "id_attribute int, id_group int, name string, position int")
    return attributes.resolve(refs, mapping, available, groups, has, auto_create, most)


def rows(df, *by):
    return sorted(tuple(r) for r in (df.select(*by) if by else df).collect())


def test_each_reason_refuses_the_whole_product(spark):
    bad = [
        (1, 0, 99, None, None, None, None),
        (2, 0, None, " ", "x", "Size", "X"),
        (3, 0, None, "size", "x", None, "X"),
        (4, 0, None, "size", "x", "G" * 65, "X"),
        (5, 0, None, "size", "x", "Size", "é" * 65),
        (6, 0, None, "two", "x", "Twice", "X"),
        (7, 0, None, "size", "s", None, None),
        (7, 1, None, "size", "x", "", "X"),
    ]
    out = resolved(spark, bad)
    assert rows(out.rejects) == [(1, "attribute is not in the shop"), (2, "a key is blank"), (3, "a name is blank"), (4, "a name is too long"), (5, "a name is too long"), (6, "a name has several ids"), (7, "a name is blank")]
    assert rows(out.combinations) == rows(out.groups) == rows(out.attributes) == rows(out.pairs) == []


def test_ids_by_id_by_keys_by_name_and_new_ones(spark):
    some = [
        (1, 0, 12, None, None, None, None),
        (1, 0, None, " size ", "s", None, None),
        (1, 0, None, "size", "s", None, None),
        (1, 1, None, "size", "m", "Size", "M"),  # mapped, but not in the shop: found by name
        (2, 0, None, "size", "xl", "Size", "XL"),
        (2, 0, None, "colour", "r", "Colour", "red"),
        (3, 0, None, "colour", "R", "Colour", "Red"),  # another value: names are compared exactly
    ]
    out = resolved(spark, some)
    assert rows(out.rejects) == []
    assert rows(out.groups) == [(4, "Colour", 5)]
    assert rows(out.attributes) == [(13, 1, "XL", 8), (14, 4, "Red", 0), (15, 4, "red", 1)]
    assert sorted((r.id_product, r.combination, r.ids) for r in out.combinations.collect()) == [(1, 0, [10, 12]), (1, 1, [11]), (2, 0, [13, 15]), (3, 0, [14])]
    assert rows(out.pairs, "group_key", "value_key", "id_group", "id_attribute") == [("colour", "R", 4, 14), ("colour", "r", 4, 15), ("size", "m", 1, 11), ("size", "xl", 1, 13)]


def test_without_creation_and_beyond_the_bound(spark):
    out = resolved(spark, [(1, 0, None, "size", "xl", "Size", "XL"), (2, 0, None, "size", "s", None, None)], auto_create=False)
    assert rows(out.rejects) == [(1, "no attribute for the keys")]
    assert [r.ids for r in out.combinations.collect()] == [[10]]
    out = resolved(spark, [(1, 0, 10, None, None, None, None), (1, 1, 10, None, None, None, None), (2, 0, 10, None, None, None, None)], most=1)
    assert rows(out.rejects) == [(1, "too many attribute references")] and rows(out.combinations, "id_product") == [(2,)]
    assert rows(resolved(spark, []).combinations) == []
