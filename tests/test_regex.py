import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgrep.functions import glob
from corpusgrep.functions.regex import POSIX, BadPattern, UnsupportedPattern, _NEGATED, is_literal, literal_prefix, quote, translate


def spans(pattern, line, **kw):
    m = re.search(translate(pattern, **kw).python.encode("latin-1"), line.encode())
    return m and m.span()


@pytest.mark.parametrize("pattern,line,span", [
    ("a.c", "xabc", (1, 4)), ("[[:digit:]]+", "ab12", (2, 4)), ("[^[:alpha:]]", "ab1", (2, 3)), ("[]a]+", "x]a", (1, 3)), ("[a&&b]", "&", (0, 1)),
    ("(?<x>ab)\\k<x>", "abab", (0, 4)), ("(?P<x_1>a)\\1", "aa", (0, 2)), ("\\Qa.b\\E+", "a.bb", (0, 4)), ("a{,2}", "a{,2}", (0, 5)), ("\\bptr\\b", "éptr", (2, 5)),
    ("^..$", "é", (0, 2)), ("\\x41\\101?", "A", None), ("x*", "", (0, 0)), ("a++b", "aab", (0, 3)), ("(?i:AB)c", "abc", (0, 3)), ("[\\w-]+", "a-b", (0, 3)), ("\\h+x", "\t x", (0, 3)),
])
def test_meaning(pattern, line, span):
    if pattern == "\\x41\\101?":
        with pytest.raises(BadPattern):
            translate(pattern)
    else:
        assert spans(pattern, line) == span


@pytest.mark.parametrize("pattern", ["*", "+a", "(", "a)", "[a", "(a)\\1", "\\C", "[[:nope:]]", "a{3,2}", "\\", "[z-a]", "\\y", "\\x{100}", "(?<x>a)(?<x>b)", "a|*"])
def test_bad(pattern):
    with pytest.raises(BadPattern):
        translate(pattern)


@pytest.mark.parametrize("pattern", ["a\\Kb", "(?R)", "(?1)", "(?(1)a)", "(?|a|b)", "(*FAIL)", "\\p{L}", "(?x)a", "(?C1)", "(?<=a+)b"])
def test_unsupported(pattern):
    with pytest.raises(UnsupportedPattern):
        translate(pattern)


def test_case_and_word():
    assert spans("é", "É", ignore_case=True) is None
    assert spans("AB", "xab", ignore_case=True) == (1, 3)
    assert spans("ptr", "PTR_at ptr", ignore_case=True, word=True) == (7, 10)


def test_routing():
    assert translate("(?:a|b)*c").deep and not translate("[ab]*c").deep and not translate("(?:ab)+").deep
    assert translate("foo(?=\\s+bar)").needs_whole and translate("\\Aab").needs_whole and not translate("foo(?=bar)").needs_whole


def test_whole_file_form_never_crosses_lines():
    whole = lambda p, data: [m.group() for m in re.finditer(translate(p).whole.encode("latin-1"), data) if m.group()]
    assert whole("efgh\\s+", b"efgh  \n  x efgh\n") == [b"efgh  "]
    assert whole("[^x]+", b"ab\ncd") == [b"ab", b"cd"]
    assert whole("a(?=\\nb)", b"a\nb\na") == [b"a"]
    assert whole("a\\nb", b"a\nb") == []


def test_file_test():
    assert [translate(p).java_file is not None for p in ("ab+", "a\\s", "\\bab\\b", "a*", "^a", "a$", "a(?!b)", "")] == [True, True, False, False, False, False, False, False]
    assert "(?!\\x0a)" in translate("a\\s").java_file


def test_negated_classes_are_complements():
    for name, members in POSIX.items():
        one, other = (re.compile(f"[{m}]".encode("latin-1")) for m in (members, _NEGATED[name]))
        assert all(bool(one.match(bytes([b]))) != bool(other.match(bytes([b]))) for b in range(256)), name


def test_literals():
    assert is_literal("a-b") and not is_literal("a.b")
    assert [literal_prefix(p) for p in ("abc.*", "abc*", "ab|c", "a?", "ab\\w", "abc{2}", "abc+")] == ["abc", "ab", "", "", "ab", "ab", "abc"]
    text = "a.b*[\\E](é)\t"
    assert spans(quote(text), "xx" + text) == (2, 2 + len(text.encode()))


ATOMS = st.sampled_from(["a", "b", "[ab]", "[^a]", ".", "\\w", "\\d", "\\s", "(?:ab|c)", "(a)", "1", "\\.", "[[:alpha:]]", "é"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ATOMS, st.sampled_from(["", "*", "+", "?", "{1,2}", "*?"])), min_size=1, max_size=5), st.text("ab1. éc\t", max_size=12))
def test_random_patterns_mean_the_same_on_bytes(parts, line):
    pattern = "".join(a + q for a, q in parts)
    plain = pattern.replace("[[:alpha:]]", "[a-zA-Z]").replace("(a)", "(?:a)")
    want = re.search(plain.encode(), line.encode())
    assert spans(pattern, line) == (want and want.span())


@pytest.mark.parametrize("pattern,name,hit", [
    ("*.cpp", ".cpp", True), ("*.cpp", "a/b.cpp", True), ("?.c", "a.c", True), ("[!a].c", "a.c", False), ("[a-c]x", "bx", True), ("a\\*", "a*", True), ("[", "[", True),
    ("[[:digit:]]", "5", True), ("a.c", "abc", False), ("[]x]", "]", True), ("*", "", True), ("a\n*", "a\nb", True),
])
def test_globs(pattern, name, hit):
    assert glob.matches(pattern, name) == hit
