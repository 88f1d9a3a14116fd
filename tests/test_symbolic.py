"""Rewriting of terms."""

import cmath
import math

from triplewright.functions.symbolic import compile_eml, differentiate, number, parts, simplify
from triplewright.plans.native import Reader, digits
from triplewright.terms import Atom

SYMBOLS = {"x", "y", "c"}


def term(text):
    return Reader(text).whole()


def test_simplify():
    for text, expect in {
        "(x + &0)": "x", "(&1 * x)": "x", "(x * &0)": "&0", "(exp of (ln of x))": "x", "(ln of (exp of x))": "x", "(exp of (ln of (x + &0)))": "x", "(x + y)": "(x + y)", "&5": "&5", "(&2 + &3)": "&5", "(&6 / &3)": "&2", "(&5 / &0)": "(&5 / &0)",
        "(x / &1)": "x", "(x eml &1)": "(exp of x)", "(&1 eml (exp of (&1 eml x)))": "(ln of x)", "(&1 eml ((&1 eml x) eml &1))": "(ln of x)",
    }.items():
        assert simplify(term(text), SYMBOLS) == term(expect), text
    assert simplify(Atom("z"), SYMBOLS) is None
    assert simplify(term("(x + y)"), SYMBOLS, known={term("(x + y)"): Atom("c")}) == Atom("c")


def test_differentiate():
    for text, expect in {"x": "&1", "c": "&0", "(y * y)": "&0", "(x + c)": "&1", "(x * x)": "(x + x)", "(c * x)": "c", "(exp of (c * x))": "((exp of (c * x)) * c)", "(ln of x)": "(&1 / x)", "(x / c)": "(&1 / c)"}.items():
        assert differentiate(term(text), "x", SYMBOLS) == term(expect), text
    assert differentiate(term("(sin of x)"), "x", SYMBOLS) is None


def test_eml():
    def value(t, env):
        if isinstance(t, Atom):
            return env[t.name]
        if number(t) is not None:
            return complex(number(t))
        a, op, b = parts(t)
        assert op == "eml"
        z = value(b, env)
        return cmath.exp(value(a, env)) - (cmath.log(z) if z else complex(-math.inf, 0))

    env = {"x": 1.7 + 0j, "y": 2.3 + 0j}
    for text, expect in {"(exp of x)": math.exp(1.7), "(ln of x)": math.log(1.7), "(x - y)": -0.6, "(x + y)": 4.0, "(x * y)": 1.7 * 2.3, "(x / y)": 1.7 / 2.3, "(inv of x)": 1 / 1.7, "(neg of x)": -1.7}.items():
        assert abs(value(compile_eml(term(text), SYMBOLS), env) - expect) < 1e-9, text
    assert compile_eml(term("(foo of x)"), SYMBOLS) is None and digits("0") == term("&0")
