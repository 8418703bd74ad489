import pytest

from marquee.functions.similarity import indel_ratio, indel_ratio_py


@pytest.mark.parametrize("a,b,out", [("kitten", "sitting", 8 / 13), ("ab", "ba", 0.5),
                                     ("dune part two", "dune", 8 / 17), ("", "", 1.0), ("a", "", 0.0)])
def test_golden(a, b, out):
    assert indel_ratio_py(a, b) == pytest.approx(out)


def test_against_dynamic_programming():
    import random
    rnd = random.Random(7)
    for _ in range(300):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12)))
        b = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
        want = 1.0 if not a and not b else 2 * dp[-1][-1] / (len(a) + len(b))
        assert indel_ratio_py(a, b) == pytest.approx(want)


def test_udf(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(indel_ratio("a", "b")).collect()]
    assert got == pytest.approx([8 / 13, 1.0])
