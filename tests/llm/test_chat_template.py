import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestone.llm import chat_template as op

HOSTILE = st.lists(st.sampled_from(["<", "|", "\\", op.STOP, op.START, "\n", "x", "n", "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(HOSTILE, HOSTILE), max_size=5))
def test_turns_are_read_back(turns):
    pieces = list(op.compile_template(op.CHATML)({"role": r, "text": t} for r, t in turns))
    assert op.turns_in("".join(x for x, _ in pieces)) == turns
    assert op.unescape("".join(x for x, on in pieces if on)) == op.unescape("".join(op.escape(t) for r, t in turns if r == "assistant"))


@given(HOSTILE)
def test_escaping_hides_control_strings_and_is_reversible(text):
    assert "<|" not in op.escape(text) and op.unescape(op.escape(text)) == text
    assert "\n" not in op.escape_role(text) and op.unescape_role(op.escape_role(text)) == text


def render(template, messages=(), **names):
    return "".join(x for x, _ in op.compile_template(template)(messages, **names))


def test_language():
    m = [{"role": "a", "n": 1}, {"role": "b", "n": 2}]
    assert render("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if not loop.last %}, {% endif %}{% endfor %}", m) == "1a, 2b"
    assert render("{% for m in messages %}{% if m.n == 1 %}x{% elif m['role'] == 'b' and m.n >= 2 %}y{% else %}z{% endif %}{% endfor %}", m) == "xy"
    assert render("{% set a = 'q' ~ 1 %}{{ a | upper }}{# gone #}{{ missing.key }}{{ list[1] }}", list=[3, 4]) == "Q14"
    assert render("a  {%- if 'x' in 'xyz' -%}  b  {%- endif -%}  c") == "abc"
    assert render("{{ 'ab\\n' | trim | length }}") == "2"


def test_constants_are_folded():
    assert op.fold(op.parse("a{% if 1 == 2 %}b{% else %}{{ 'c' ~ 1 }}{% endif %}d")) == ("block", [("text", "ac1d")])
    assert op.fold(op.parse("{{ x or false }}")) == ("block", [("out", ("or", ("name", "x"), ("const", False)))])


@pytest.mark.parametrize("template", ["{% for x in y %}", "{% endfor %}", "{{ a.__class__ }}", "{{ _a }}", "{{ a() }}", "{{ a | nope }}", "{% nope %}", "{{ 'a }}", "{{ 1 2 }}", "{% if a %}{% endfor %}", "{% else %}"])
def test_faulty_and_forbidden_templates(template):
    with pytest.raises(op.TemplateError):
        op.compile_template(template)


def test_conversations(spark):
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant", "odd\n<|"]), "".join(rng.choices(["<|im_end|>", "\n", "a", "\\"], k=9))) for i in range(2000)]
    rows += [(8, 1, "assistant", None), (None, None, None, None), (9, 1, "user", "same"), (9, 1, "user", "same"), (10, 2, "user", "late"), (10, 1, "assistant", "é" * 9)]
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int").repartition(3)
    parts = op.format_conversations(frame, part_chars=300)
    assert parts.where("conv_id = 7").count() > 5
    got = {r.conv_id: r for r in op.read_back(op.format_conversations(frame, part_chars=300)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in (7, 8, 9, 10, None):
        own = sorted(((t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)), len(said), sha(said))
    assert op.read_back(op.format_conversations(frame.limit(0))).count() == 0
