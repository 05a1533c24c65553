import pytest

from tesserae.plans.query import Probe, Term, parse, split


def test_words_phrases_and_exclusions():
    q = parse('round "exact words" -gone -"two words"')
    assert q.pos == [Term("round"), Term("exact words", True)]
    assert q.neg == [Term("gone"), Term("two words", True)]


def test_filters():
    q = parse('a path:Os -path:"my notes" ext:.MD ext:pdf IN:Image -in:pdf')
    assert (q.paths, q.not_paths, q.exts, q.kinds) == (["Os"], ["my notes"], ["md", "pdf"], ["image", "pdf"])


@pytest.mark.parametrize("text", ['"', "-", 'a" OR b', "NEAR(", "*", "title:x", "", "  ", '"foo bar', "- foo", "path: foo", "::", '""', "-\"", "½ ²"])
def test_hostile_queries_parse(text):
    parse(text)


def test_unclosed_quote_is_words():
    assert parse('"foo bar').pos == [Term("foo"), Term("bar")]


def test_words_without_letters_are_dropped():
    assert parse("* -- !!").pos == []


def test_trees():
    assert Term("round-rob").tree() == Probe(("round", "rob"), True)
    assert Term("a b", True).tree() == Probe(("a", "b"), False)
    assert Term("x", alts=("aa", "bb")).tree() == ("or", [Probe(("aa",)), Probe(("bb",))])
    assert Term("ab", parts=(Term("a"), Term("b"))).tree() == ("and", [Probe(("a",), True), Probe(("b",), True)])


def test_shown():
    assert parse('the -process path:"my notes"').shown() == 'the -process path:"my notes"'
    assert Term("x", alts=("aa",)).shown() == "aa"


def test_split_folds():
    assert split("Café-ÉTÉ x_1") == ("cafe", "ete", "x", "1")


def test_keywords():
    q = parse("How does FCFS decide -x which process runs path:os").keywords({"does", "which"})
    assert [t.text for t in q.pos] == ["FCFS", "decide", "process", "runs"] and q.any and q.neg == [] and q.paths == ["os"]
