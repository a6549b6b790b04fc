"""GDP totals for the published series, computed independently (FIXTURES.md part 3)."""

import pytest

from scenaria.plans import costs
from scenaria.sources import read_gdp

# Published series, billion USD_2017/yr, 2020..2100 by five years
SERIES = {
    "China": [
        23516.1, 30146.2, 36229.4, 41754.9, 46183.5, 50423.1,
        54381.7, 57817.2, 61129, 64264.4, 66786.7, 68664.1,
        70044.6, 71061.1, 71883.6, 72552.3, 72931.3,
    ],
    "Japan": [
        5113.07, 5485.67, 5705.2, 5948.75, 6157.06, 6371.42,
        6598.6, 6815.61, 7007.88, 7173.6, 7306.8, 7413.1,
        7508.57, 7601.83, 7687.09, 7751.97, 7782.79,
    ],
    "South Korea": [
        2145.25, 2430.62, 2670.11, 2844.86, 2969.21, 3058.72,
        3120.21, 3148.34, 3147.11, 3133.4, 3104.19, 3059.14,
        2999.27, 2928.87, 2850, 2764.51, 2675.99,
    ],
    "Mongolia": [
        38.434, 46.8166, 56.3342, 68.0089, 80.7024, 94.6743,
        110.563, 129.041, 150.506, 175.207, 202.339, 231.524,
        262.873, 296.553, 332.772, 371.48, 412.447,
    ],
}
GOLDEN = {
    (2020, True): dict(CHN=5.574695e14, JPN=8.584586e13, KOR=3.928854e13, MNG=9.876320e11, Total=6.835915e14),
    (2020, False): dict(CHN=5.185555e14, JPN=8.149430e13, KOR=3.742705e13, MNG=8.678215e11, Total=6.383447e14),
    (2040, True): dict(CHN=2.552538e14, JPN=3.576073e13, KOR=1.646492e13, MNG=5.034033e11, Total=3.079829e14),
    (2040, False): dict(CHN=1.378549e14, JPN=1.753959e13, KOR=8.402898e12, MNG=2.586507e11, Total=1.640561e14),
}


@pytest.fixture(scope="module")
def gdp(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("gdp") / "gdp.csv"
    years = range(2020, 2101, 5)
    lines = ['"Model","Scenario","Region","Variable","Unit",' + ",".join(f'"{y}"' for y in years)]
    for name, values in SERIES.items():
        lines.append(f'"m","SSP2","{name}","GDP|PPP","u",' + ",".join(map(str, values)))
    lines.append('"(c) attribution line"')
    path.write_text("\n".join(lines) + "\n")
    return read_gdp(spark, str(path))


def test_attribution_line_is_dropped(gdp):
    assert sorted(r.Region for r in gdp.collect()) == ["China", "Japan", "Mongolia", "South Korea"]


@pytest.mark.parametrize("first, keep", list(GOLDEN))
def test_discounted_totals(gdp, first, keep):
    yearly = costs.interpolated_gdp(gdp, first, 2050, keep_outside=keep)
    got = {r.Sr2: r.GDP for r in costs.discounted_gdp(yearly).collect()}
    # the golden values are printed with seven digits
    assert got == pytest.approx(GOLDEN[first, keep], rel=5e-7)


def test_interpolation_hits_source_years(gdp):
    yearly = costs.interpolated_gdp(gdp, 2020, 2050)
    got = {r.YEAR: r.GDP for r in yearly.filter("Sr2 = 'JPN'").collect()}
    assert len(got) == 31 + 10
    assert got[2025] == 5485.67 and got[2100] == 7782.79
    assert got[2021] == pytest.approx(5113.07 + (5485.67 - 5113.07) / 5)
