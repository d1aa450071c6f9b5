import pytest
from hypothesis import given, settings, strategies as st

from panelforge.llm import chat


def test_language():
    def out(source, **values):
        return chat.Template(source).render(**values)[0]

    assert out("a{{ 1 ~ 'b' | upper }}c") == "a1Bc"
    assert out("{% for x in xs %}{{ loop.index }}{{ x.a }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": 1}, {"a": None}]) == "11,2"
    assert out("{% if a == 1 %}x{% elif a in b %}y{% else %}z{% endif %}", a=2, b=[2]) == "y"
    assert out("{% set k = a[0] %}{{ k if k > 3 else 'no' }}{{ (true and false) or none }}", a=[5]) == "5"
    assert out("{{ a.__class__ }}{{ a.b.c }}", a="x") == ""
    for bad in ("{{ f(1) }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a | nothing }}", "{% import os %}", "{{ }}", "{{ a b }}", "{{ 'x }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    with pytest.raises(chat.TemplateError):
        out("{% for x in y %}{% endfor %}", y="text")


def test_constants_fold():
    assert chat.Template("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% elif true %}c{% else %}y{% endif %}d").tree == [("text", "ab1cd")]
    assert chat.Template("{{ a ~ ('b' ~ 'c') }}").tree == [("show", ("binary", "~", ("name", "a"), ("const", "bc")))]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "", "\\"]), st.text(alphabet="<|>\\n\nim_startend é𝄞", max_size=40))))
@settings(max_examples=200, deadline=None)
def test_round_trip(turns):
    text, spans = chat.Template().render(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.turns_of(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "first", "x"), (1, 2, "assistant", "<|im_end|>", None),
            (None, 1, "assistant", "é" * 50000, "y"), (2, 1, "user", "", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.id: r for r in chat.formatted(df).collect()}
    assert chat.turns_of(got[1].formatted) == [("", "first"), ("user", ""), ("user", ""), ("assistant", "<|im_end|>")]
    back = {r.id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert back[None].loss_chars == 50000 and back[2].loss_chars == 0 and back[1].n_turns == 4
    assert chat.read_back(chat.formatted(df.limit(0))).collect() == []
    with pytest.raises(ValueError):
        chat.turns_of(got[2].formatted + "x")
