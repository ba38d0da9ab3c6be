import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions.units import PayScale, Unit, convert, number, read_figure, stated_units
from millrace.operators.quantities import to_usd_per_year

FACTORS = {("USD", "currency"): 1.0, ("EUR", "currency"): 1.09, ("GBP", "currency"): 1.27, ("CAD", "currency"): 0.73, ("PLN", "currency"): 0.25, ("INR", "currency"): 0.012, ("AUD", "currency"): 0.66, ("SGD", "currency"): 0.74}
FACTORS |= {("hour", "period"): 2080.0, ("day", "period"): 260.0, ("week", "period"): 52.0, ("month", "period"): 12.0, ("year", "period"): 1.0}
PAY = PayScale(FACTORS)


def test_unit_algebra():
    metre, second, minute = Unit.of(length=1), Unit.of(time=1), Unit.of(60, time=1)
    assert convert(3, metre / second, metre / minute) == pytest.approx(180)
    assert convert(25, Unit.of(1, 273.15, temperature=1), Unit.of(temperature=1)) == pytest.approx(298.15)
    assert convert(77, Unit.of(5 / 9, 459.67 * 5 / 9, temperature=1), Unit.of(1, 273.15, temperature=1)) == pytest.approx(25)
    assert (metre * metre).dim == (metre**2).dim
    with pytest.raises(ValueError):
        convert(1, metre, second)
    with pytest.raises(ValueError):
        Unit.of(1, 273.15, temperature=1) * metre


@pytest.mark.parametrize(("text", "value"), [("1,500", 1500), ("1.500", 1500), ("28.50", 28.5), ("34,50", 34.5), ("44,25,000", 4425000), ("0.114", 0.114), ("16'650", 16650), ("77 000", 77000), ("1,234.56", 1234.56), ("1.234,5", 1234.5), ("7", 7), ("1.234.567", 1234567)])
def test_numbers(text, value):
    assert number(text) == pytest.approx(value)


@pytest.mark.parametrize(
    ("salary", "description", "usd"),
    [
        ("$28 an hour incl. 13th salary talk", None, (58240, 58240)),
        ("USD 49,000-70,500/yr (40h week)", None, (49000, 70500)),
        ("PLN 28.900 do 37.250/mies.", None, (86700, 111750)),
        ("£31 – 38k per annum", None, (39370, 48260)),
        ("€ 53k p.a.", None, (57770, 57770)),
        ("64 – 101 pounds hourly", None, (169062, 266802)),
        ("Up to A$131.50/h", None, (180523, 180523)),
        ("98-108 USD/h + 401k match", None, (203840, 224640)),
        ("$0.114M a year", None, (114000, 114000)),
        ("37.5 LPA", None, (45000, 45000)),
        ("28.5 lakh per annum", None, (34200, 34200)),
        ("€14,5K brutto/Monat", None, (189660, 189660)),
        ("700 - 1,015 US dollars per diem", None, (182000, 263900)),
        ("$2,650–3,550 weekly", None, (137800, 184600)),
        ("C$142 thousand - C$198 thousand/yr, 25 days off", None, (103660, 144540)),
        ("90000", "Intro. Remuneration is yearly and paid in euros. More.", (98100, 98100)),
        ("226", "Remuneration is hourly and paid in zloty.", (117520, 117520)),
        ("565", "All pay amounts: GBP, daily.", (186563, 186563)),
        ("$141,000", "All pay amounts: EUR, monthly.", (141000, 141000)),
        ("141,000", "We paid 5 euros.", None),
        ("unpaid trial of 2 days", None, None),
        ("see the 401k plan", None, None),
        ("equity only", None, None),
        ("", None, None),
        (None, None, None),
        ("-", "All pay amounts: EUR, monthly.", None),
    ],
)
def test_pay(salary, description, usd):
    assert PAY.range_of(salary, description) == usd


@given(st.text(max_size=60))
def test_any_text_reads_or_not(text):
    figure = read_figure(text)
    assert figure is None or figure.low <= figure.high
    stated_units(text)


def test_operator(spark, rows):
    units = spark.createDataFrame([(c, k, f) for (c, k), f in FACTORS.items()], "unit_code string, unit_kind string, factor double")
    data = [("1", "$10k", None, 1), ("2", "90000", "All pay amounts: EUR, yearly.", 1), ("3", None, None, 1), (None, "£1,000/mo", None, 1), ("5", "x" * 30_000 + " $5", None, 1), ("6", "$1", "", 1), ("6", "$1", "", 1), ("7", "5", None, 1), ("8", "from 4 to 5", "All pay amounts: USD, yearly.", 1), ("9", "4 to 5 zł", "All pay amounts: USD, yearly.", 1)]
    df = spark.createDataFrame(data, "id string, salary string, job_desc string, low_usd int")
    assert rows(to_usd_per_year(df, "id", "salary", "job_desc", units)) == sorted([("1", 10000, 10000), ("2", 98100, 98100), (None, 15240, 15240), ("5", 5, 5), ("6", 1, 1), ("6", 1, 1), ("8", 4, 5), ("9", 1, 1)], key=repr)
    assert rows(to_usd_per_year(df.limit(0), "id", "salary", "job_desc", units)) == []
    assert rows(to_usd_per_year(df, "id", "salary", "job_desc", units.limit(0))) == []


def test_currency_only_in_an_aside(spark, rows):
    units = spark.createDataFrame([(c, k, f) for (c, k), f in FACTORS.items()], "unit_code string, unit_kind string, factor double")
    said = "All pay amounts: EUR, monthly."
    data = [("1", "55,000 plus $5,000 bonus", said), ("2", "5,000 (up to £900 more)", said), ("3", "5,000 + 200 euros", None), ("4", "$5,000 plus €900 bonus", said)]
    df = spark.createDataFrame(data, "id string, salary string, job_desc string")
    assert rows(to_usd_per_year(df, "id", "salary", "job_desc", units)) == [("1", 719400, 719400), ("2", 65400, 65400), ("4", 5000, 5000)]
