import pytest

from cubeleaf.plans.parser import LanguageError, angle_value, date_value, parse, tokens
from cubeleaf.plans.patterns import regex_of


def test_precedence():
    assert parse("a OR b AND NOT c") == ("bin", "or", ("col", "a"), ("bin", "and", ("col", "b"), ("un", "not", ("col", "c"))))
    assert parse("-x**2") == ("un", "-", ("bin", "**", ("col", "x"), ("lit", 2)))
    assert parse("1 + 2 * 3 & 4") == ("bin", "&", ("bin", "+", ("lit", 1), ("bin", "*", ("lit", 2), ("lit", 3))), ("lit", 4))


def test_literals():
    assert parse("'a''b'") == ("lit", "ab")
    assert parse("0x1F") == ("lit", 31)
    assert parse("99999999999999999999") == ("lit", 2**63 - 1)
    assert parse("T") == ("lit", True)
    assert date_value("2020-02-12") == date_value("12Feb2020") == 58891.0
    assert date_value("2020/02/12/12:00") == 58891.5
    assert angle_value("12h0m0s") == pytest.approx(3.141592653589793)
    assert tokens("1.4GHz")[0].value == (1.4, "GHz")


def test_ranges_and_subscripts():
    assert parse("a IN [1:7:3, 9]")[2] == ("items", [("range", ("lit", 1), ("lit", 7), ("lit", 3)), ("lit", 9)])
    assert parse("V[2:end, ]") == ("sub", ("col", "V"), [("range", ("lit", 2), ("end",), None), ("range", None, None, None)])


def test_errors():
    for text in ("a +", "(a", "'open", "a BETWEEN 1", "a LIKE b"):
        with pytest.raises(LanguageError):
            parse(text)


def test_patterns():
    assert regex_of("s", "a%b_") == r"(?d)\A(?:a.*b.)\z"
    assert regex_of("p", "x*{a,b}[!c]?") == r"(?d)\A(?:x.*(?:a|b)[^c].)\z"
    assert regex_of("m", "b+", True) == "(?di)b+"
