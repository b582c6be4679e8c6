import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K


def one(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_pair_key(spark):
    got = one(spark, K.pair_key, ["r01-pair-00000012", "R1 PAIR 12", " r01_pair_12 ", "r02-pair-00000012", None, "", "pair", "r01-pair-"])
    assert got == ["1:12", "1:12", "1:12", "2:12", None, None, None, None]


def test_family_key(spark):
    same = ["own/the-name", "OWN/The-Name", " own / the-name ", "own／the‐name", "own\\the_name", "own/the-name.git", "own/the-name/", "forge.example/own/the-name", "https://forge.example/own/the-name"]
    assert set(one(spark, K.family_key, same)) == {"own/the-name"}
    assert one(spark, K.family_key, [None, "", "  ", "owner/the-name", "own/thename"]) == [None, None, None, "owner/the-name", "own/thename"]


def test_locator_key(spark):
    same = ["https://forge.example/own/name", "HTTPS://Forge.Example/Own/Name/", "git@forge.example:own/name.git", "ssh://git@forge.example:22/own/name", "git+https://forge.example/own/name.git#stable", "forge.example/own/name", "http://www.forge.example//own/name", "https://forge.example/own/name/tree/main", "https://forge.example/own/name?tab=source", "git://forge.example/OWN/NAME.git/"]
    assert set(one(spark, K.locator_key, same)) == {"forge.example/own/name"}
    assert one(spark, K.locator_key, [None, "", "n/a", "https://other.example/own/name", "https://forge.example/own/name_2"]) == [None, None, None, "other.example/own/name", "forge.example/own/name_2"]


H = "0123456789abcdef0123456789abcdef01234567"


def test_revision_core(spark):
    same = [H, H.upper(), f'"{H}"', f"{H}^{{commit}}", f"commit {H}", f"git:{H}", f"v1.2-33-g{H}", f"https://forge.example/o/n-gateway/commit/{H}", f"​{H}", f"  {H} "]
    assert set(one(spark, K.revision_core, same)) == {H}
    assert one(spark, K.revision_core, [None, "", " ", "-", "n/a", "TBD", "none", "unknown", "undefined", "0" * 40]) == [None] * 10
    assert one(spark, K.revision_core, ["deadbeefcafe"]) == ["deadbeefcafe"]


def test_agreement(spark):
    rows = [(H, H, True, False), (H, H[:8], True, False), (H, H[:7], False, False), (H, H[:20] + "x" + H[21:], False, True), (H, H[:10] + H[12:], False, True), (H, "x" * 3 + H[3:], False, False), (None, H, False, False), (None, None, False, False), (H[:20], H[:19] + "x", False, False)]
    df = spark.createDataFrame(rows, "a string, b string, agree boolean, typo boolean")
    for r in df.select("*", K.agree(F.col("a"), F.col("b")).alias("x"), K.mistyped(F.col("a"), F.col("b")).alias("y")).collect():
        assert (r.x, r.y) == (r.agree, r.typo), r


@pytest.mark.parametrize("f", [K.pair_key, K.family_key, K.locator_key, K.revision_core, K.split_key, K.case_key])
def test_any_text(spark, f):
    odd = ["\x00", "a" * 100_000, "///", "::", "💥", "é" * 50, "\n", "'\"", "^{}", "//host", "@", "https://"]
    assert len(one(spark, f, odd)) == len(odd)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=10))
def test_fold_is_idempotent(spark, values):
    once = one(spark, K.fold, [v.replace("\x00", "") for v in values])
    assert one(spark, K.fold, once) == once
