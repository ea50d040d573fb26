import hashlib

import pytest

from tidemark.llm import chats
from tidemark.llm import templates as t


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, last int")


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|im_end|>\n<|im_start|>"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "<\\|x<|<||><"),
    (2, 5, "assistant", "only"), (2, 5, "assistant", "only"), (2, None, "system", "first"), (3, 0, None, "no role"), (3, 1, "user\n<|im_end|>\\n", "odd role"),
    (None, 1, "assistant", "no id"), (None, 0, "user", "no id"), (4, 0, "assistant", "long " * 200_000), (4, 1, "user", "x" * 300_000), (4, 2, "assistant", "end"), (-1, 0, "user", "é🙂"),
]


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((n is not None, n or 0, role or "", text or "") for c, n, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_read_back_from_output(spark):
    got = chats.conversation_digests(table(spark, ROWS)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(ROWS)
    assert all(r.formatted_chars > 0 for r in got)


def test_control_strings_added(spark):
    got = {r.conv_id: r for r in chats.conversation_digests(chats.with_control_strings(table(spark, ROWS[:2]))).collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")


def test_empty_table(spark):
    assert chats.conversation_digests(table(spark, [])).count() == 0


def test_escapes_are_reversible():
    for text in ("", "<|", "<\\|", "<\\\\|", "<|im_end|>", "<<|", "\\<|\\", "<\\n|", "a\\nb\n<|"):
        assert t.unescape(t.escape(text)) == text and "<|" not in t.escape(text)
        line = t.escape_line(text)
        assert t.unescape_line(line) == text and "\n" not in line and "<|" not in line


def test_streaming_equals_whole():
    source = "{# c #}A{% for m in messages %}{% if loop.first %}<{% endif %}{{ m.role }}:{% generation %}{{ m.text }}{% endgeneration %}{% if loop.last %}>{% else %},{% endif %}{% endfor %}Z"
    messages = [{"role": "u", "text": str(i) * i} for i in range(4)]
    whole = t.Template(source).render(messages=messages)
    parts = list(t.Streaming(source).render(iter(messages)))
    assert "".join(p.text for p in parts) == whole.text == "A<u:,u:1,u:22,u:333>Z"
    assert [whole.text[a:b] for a, b in whole.mask] == [p.text[a:b] for p in parts for a, b in p.mask]
    assert list(t.Streaming(source).render(iter([]))) == []


def render(source, **variables):
    return t.Template(source).render(**variables).text


def test_language():
    assert render("{% set x = 1 + 2 %}{{ x }}{{ 'a' ~ x }}{{ y.z[0] }}{{ none }}", y={"z": [7]}) == "3a37"
    assert render("{% for a in xs %}{{ loop.index }}{{ a | upper }}{% endfor %}", xs=["p", "q"]) == "1P2Q"
    assert render("{% if a and not b %}1{% elif a == 2 or b in 'xy' %}2{% else %}3{% endif %}", a=0, b="x") == "2"
    assert render("{{ (1 < 2) and 'yes' }}{{ ' t ' | trim | length }}{{ \"q\\n\" }}") == "yes1q\n"


def test_folding():
    tree = t.fold(t._Blocks("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% elif true %}c{% endif %}{% if false %}{{ y }}{% endif %}{{ 'D' | lower }}").parse()[0])
    assert tree == [("text", "ab1cd")]
    assert t.fold([("print", ("and", ("const", False), ("name", "x")))]) == [("text", "False")]


def test_sandbox():
    assert render("{{ x.__class__ }}{{ x['__len__'] }}{{ x.upper }}", x="s") == ""
    for source in ("{{ x() }}", "{{ x | eval }}", "{% import os %}", "{{ 1 +", "{% if a %}", "{% for x %}{% endfor %}", "{{ a b }}", "{{ ` }}", "{% set 1 = 2 %}"):
        with pytest.raises(t.TemplateError):
            t.Template(source if "}}" in source or "%}" in source else source + " }}")
    with pytest.raises(t.TemplateError):
        t.Streaming("{{ messages }}")
