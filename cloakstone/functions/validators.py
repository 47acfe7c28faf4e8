"""Check-digit validators as Spark expressions. Each takes a string column in any punctuation and is null-safe (null: false)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _values(d: Column) -> Column:
    """Characters as code - 48, so digits are their values."""
    return F.transform(F.split(d, ""), lambda x: F.ascii(x) - 48)


def _weighted(v: Column, weights: Sequence[int], start: int = 1) -> Column:
    """Sum of values from a position times weights."""
    return F.aggregate(F.zip_with(F.slice(v, start, len(weights)), F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0), lambda a, b: a + b)


def _all_equal(d: Column) -> Column:
    return d.rlike(r"^(.)\1*$")


def _at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def _checked(c: Column, n: int, rule: Callable[[Column], Column]) -> Column:
    """Exactly n digits, not all equal, and the rule over their values."""
    d = _digits(c)
    return F.coalesce((F.length(d) == n) & ~_all_equal(d) & F.when(F.length(d) == n, rule(_values(d))), F.lit(False))


def _mod11(sum_: Column) -> Column:
    """11 - sum mod 11; 10 and 11 count as 0."""
    r = sum_ % 11
    return F.when(r < 2, 0).otherwise(11 - r)


def valid_cpf(c: Column) -> Column:
    return _checked(c, 11, lambda v: (_mod11(_weighted(v, range(10, 1, -1))) == _at(v, 9)) & (_mod11(_weighted(v, range(11, 1, -1))) == _at(v, 10)))


_CNPJ = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def _cnpj(v: Column) -> Column:
    return (_mod11(_weighted(v, _CNPJ[1:])) == _at(v, 12)) & (_mod11(_weighted(v, _CNPJ)) == _at(v, 13))


def valid_cnpj(c: Column) -> Column:
    """The order number (digits 9 to 12) starts at 1."""
    return _checked(c, 14, _cnpj) & (F.substring(_digits(c), 9, 4) != "0000")


def valid_alpha_cnpj(c: Column) -> Column:
    """With letters: a character counts as its code - 48."""
    t = F.regexp_replace(F.upper(c), "[./-]", "")
    shape = t.rlike("^[0-9A-Z]{12}[0-9]{2}$") & t.rlike("[A-Z]") & (F.substring(t, 9, 4) != "0000")
    return F.coalesce(F.when(shape, _cnpj(_values(t))), F.lit(False))


_PIS = (3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def valid_pis(c: Column) -> Column:
    return _checked(c, 11, lambda v: _mod11(_weighted(v, _PIS)) == _at(v, 10))


def valid_cnh(c: Column) -> Column:
    def rule(v: Column) -> Column:
        a, b = _weighted(v, range(9, 0, -1)) % 11, _weighted(v, range(1, 10)) % 11
        second = b - F.when(a == 10, 2).otherwise(0)
        second = F.when(second < 0, second + 11).otherwise(second)
        return (F.when(a == 10, 0).otherwise(a) == _at(v, 9)) & (F.when(second == 10, 0).otherwise(second) == _at(v, 10))

    return _checked(c, 11, rule)


def valid_luhn(c: Column) -> Column:
    d = _digits(c)
    return F.coalesce(F.length(d).between(13, 19) & ~_all_equal(d) & F.call_function("luhn_check", d), F.lit(False))


def valid_voter(c: Column) -> Column:
    def rule(v: Column) -> Column:
        state = _at(v, 8) * 10 + _at(v, 9)
        fix = lambda r: F.when(r == 10, 0).when((r == 0) & state.isin(1, 2), 1).otherwise(r)
        first = fix(_weighted(v, range(2, 10)) % 11)
        second = fix((_at(v, 8) * 7 + _at(v, 9) * 8 + first * 9) % 11)
        return state.between(1, 28) & (first == _at(v, 10)) & (second == _at(v, 11))

    return _checked(c, 12, rule)


def valid_cns(c: Column) -> Column:
    return _checked(c, 15, lambda v: (_weighted(v, range(15, 0, -1)) % 11 == 0) & (_at(v, 0).isin(1, 2) | (_at(v, 0) >= 7)))


def valid_renavam(c: Column) -> Column:
    d = _digits(c)
    whole = F.when(F.length(d).between(9, 11), F.lpad(d, 11, "0"))
    return _checked(whole, 11, lambda v: _weighted(v, _PIS) * 10 % 11 % 10 == _at(v, 10))


def valid_iban(c: Column) -> Column:
    t = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    turned = F.concat(F.substr(t, F.lit(5)), F.substring(t, 1, 4))
    # letters are two digits; the remainder goes along the string
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, x: F.when(x.rlike("[0-9]"), (r * 10 + F.ascii(x) - 48) % 97).otherwise((r * 100 + F.ascii(x) - 55) % 97))
    return F.coalesce(F.when(t.rlike("^[0-9A-Z]{15,34}$"), rest == 1), F.lit(False))


def _mod10(v: Column) -> Column:
    """Weights 2, 1, 2, ... from the right; digits of products add up."""
    sums = F.aggregate(F.transform(F.reverse(v), lambda x, i: F.when(i % 2 == 0, F.floor(x * 2 / 10).cast("int") + x * 2 % 10).otherwise(x)), F.lit(0), lambda a, b: a + b)
    return (10 - sums % 10) % 10


def _sum11(v: Column) -> Column:
    """Weights 2 to 9 again and again, from the right."""
    return F.aggregate(F.transform(F.reverse(v), lambda x, i: x * (2 + i % 8)), F.lit(0), lambda a, b: a + b)


def _part(v: Column, a: int, b: int) -> Column:
    return F.slice(v, a + 1, b - a)


def _boleto_code(v: Column) -> Column:
    r = 11 - _sum11(F.concat(_part(v, 0, 4), _part(v, 5, 44))) % 11
    return _at(v, 3).isin(0, 9) & (F.when(r > 9, 1).otherwise(r) == _at(v, 4))


def _bill_digit(v: Column, by11: Column) -> Column:
    r = _sum11(v) % 11
    return F.when(by11, F.when(r < 2, 0).when(r == 10, 1).otherwise(11 - r)).otherwise(_mod10(v))


def _bill_code(v: Column) -> Column:
    return (_at(v, 0) == 8) & (_at(v, 2) >= 6) & (_bill_digit(F.concat(_part(v, 0, 3), _part(v, 4, 44)), _at(v, 2) >= 8) == _at(v, 3))


def _sized(c: Column, n: int, rule: Callable[[Column], Column]) -> Column:
    d = _digits(c)
    return F.coalesce(F.when(F.length(d) == n, rule(_values(d))), F.lit(False))


def valid_barcode(c: Column) -> Column:
    """44 digits of a bank slip or of a bill."""
    return F.coalesce(c.rlike("^[0-9]{44}$"), F.lit(False)) & _sized(c, 44, lambda v: _boleto_code(v) | _bill_code(v))


def valid_boleto(c: Column) -> Column:
    """47 digits of a bank slip's line."""

    def rule(v: Column) -> Column:
        fields = (_mod10(_part(v, 0, 9)) == _at(v, 9)) & (_mod10(_part(v, 10, 20)) == _at(v, 20)) & (_mod10(_part(v, 21, 31)) == _at(v, 31))
        return fields & _boleto_code(F.concat(_part(v, 0, 4), _part(v, 32, 33), _part(v, 33, 47), _part(v, 4, 9), _part(v, 10, 20), _part(v, 21, 31)))

    return _sized(c, 47, rule)


def valid_bill(c: Column) -> Column:
    """48 digits of a bill's line."""

    def rule(v: Column) -> Column:
        ok = (_at(v, 0) == 8) & (_at(v, 2) >= 6)
        for b in range(4):
            ok &= _bill_digit(_part(v, 12 * b, 12 * b + 11), _at(v, 2) >= 8) == _at(v, 12 * b + 11)
        return ok & _bill_code(F.concat(*[_part(v, 12 * b, 12 * b + 11) for b in range(4)]))

    return _sized(c, 48, rule)


def valid_tracking(c: Column) -> Column:
    def rule(v: Column) -> Column:
        r = 11 - _weighted(v, (8, 6, 4, 2, 3, 5, 9, 7)) % 11
        return F.when(r == 10, 0).when(r == 11, 5).otherwise(r) == _at(v, 8)

    return _sized(c, 9, rule)


def valid_certificate(c: Column) -> Column:
    d = _digits(c)
    return F.coalesce((F.length(d) == 32) & (F.substring(d, 9, 2) == "55") & (F.substring(d, 15, 1) != "0") & F.substring(d, 11, 4).between("1800", "2099"), F.lit(False))


# Codes of the states.
STATES = ("11", "12", "13", "14", "15", "16", "17", "21", "22", "23", "24", "25", "26", "27", "28", "29", "31", "32", "33", "35", "41", "42", "43", "50", "51", "52", "53")


def valid_fiscal_key(c: Column) -> Column:
    """44 characters: state, year and month, issuer (valid on its own), model to code, check digit by modulo 11."""
    t = F.replace(c, F.lit(" "), F.lit(""))
    issuer = F.substring(t, 7, 14)
    shape = t.rlike("^[0-9]{6}[0-9A-Z]{14}[0-9]{24}$") & F.substring(t, 1, 2).isin(*STATES) & (F.substring(t, 3, 2) >= "06") & F.substring(t, 5, 2).between("01", "12")
    known = valid_cnpj(F.when(issuer.rlike("^[0-9]+$"), issuer)) | valid_alpha_cnpj(issuer) | (issuer.startswith("000") & valid_cpf(F.substring(issuer, 4, 11)))
    return F.coalesce(F.when(shape, known & (_mod11(_sum11(_part(_values(t), 0, 43))) == _at(_values(t), 43))), F.lit(False))
