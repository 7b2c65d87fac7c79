import pytest
from hypothesis import given, settings, strategies as st

from strataquery.plans.lang import Filter, QueryError, complete, parse, result_type, tokenize
from strataquery.plans.predicates import safe_regex, validate


def test_fields_text_and_signs():
    q = parse('repo:payments lang:Go -test "hello world" https://x.y +keep path:"a b" -file:c')
    assert q.text == "hello world https://x.y +keep"
    assert q.filters == (Filter("repository", "payments"), Filter("language", "Go"), Filter("content", "test", True), Filter("path", "a b"), Filter("file", "c", True))


def test_values_fold_and_trim():
    assert parse("path:A path:a path:b").values("path") == ["A", "b"]


@pytest.mark.parametrize("raw", ['"open', "repo:", 'x "y\\', 'lang:""'])
def test_refused(raw):
    with pytest.raises(QueryError):
        parse(raw)


def test_escape_only_in_quotes():
    assert tokenize(r'a\b "c\"d"') == ["a\\b", 'c"d']


def test_result_types():
    assert result_type(parse("x")) == "content"
    assert result_type(parse("type:diff x")) == "diff"
    for bad in ("-type:diff", "type:diff type:commit", "type:nope"):
        with pytest.raises(QueryError):
            result_type(parse(bad))


def test_filters_a_result_lacks_are_errors():
    validate(parse("author:a"), "commit")
    with pytest.raises(QueryError):
        validate(parse("author:a"), "content")


@pytest.mark.parametrize("bad", ["(?=x)", r"(a)\1", "(?<!x)y", "a*+"])
def test_regex_subset(bad):
    with pytest.raises(QueryError):
        safe_regex(bad)
    assert safe_regex("a+b?") == "a+b?"


def test_completion():
    assert [c["insert_text"] for c in complete("lang:ja", 7)] == ["language:Java", "language:JavaScript"]
    assert complete("-re", 3)[0] == {"insert_text": "-repository:", "replace_start": 0, "replace_end": 3}
    assert complete("😀 la", 5)[0]["replace_start"] == 3
    assert complete("nope:x", 6) == []
    assert complete("repo:a", 6, {"repository": ["a b", "c"]})[0]["insert_text"] == 'repository:"a b"'


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab:"\\ -+\t', max_size=20))
def test_any_text_parses_or_is_refused(raw):
    try:
        q = parse(raw)
    except QueryError:
        return
    assert all(f.value.strip() for f in q.filters)
