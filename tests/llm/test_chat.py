import hashlib
import random

import duckdb
import pytest

from ripplet.llm import chat, entries
from ripplet.llm.template import Template, TemplateError, escape, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["", "\\", "\\\\", "###", "####", "#####", "</turn>", "<</turn>", "</turn", "\\</turn>", "### assistant: x</turn>\n", "a:b", "::", "\n", "x\\", "é\U0001f600###", "\\### Assistant: </turn> ok"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """Digests by conversation, from the rows themselves."""
    found = {}
    for key in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, i, role or "", text or "") for i, (k, t, role, text) in enumerate(rows) if k == key))
        own = [(role, text) for _, _, role, text in turns]
        loss = "".join(text for role, text in own if role == "assistant")
        found[key] = (len(own), sha("".join(f"{role}\n{text}\n" for role, text in own)), len(loss), sha(loss))
    return found


def test_query_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    want = con.execute(entries.oracle_sql()["op12_chat"])
    columns = [c[0] for c in want.description]
    got = entries.op12_chat(spark, small)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_hard_texts_and_odd_rows_come_back(spark):
    rng = random.Random(3)
    rows = [(key, t, rng.choice(["user", "assistant", "system", None, "a:b", "</turn>", "as\\sistant"]), rng.choice([*HARD, None, "".join(rng.choices("\\#</turn>: \n", k=30))])) for key in (None, 1, 2, 3) for t in [None, *range(40)]]
    rows.append((4, 0, "assistant", "long </turn> " * 100_000))
    rows += [(5, 1, "user", "same")] * 3
    shuffled = rng.sample(rows, len(rows))
    table = spark.createDataFrame([(*r, 7, "clash") for r in shuffled], SCHEMA + ", section int, piece string").repartition(5)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_turns(table)).collect()} == plain(rows)


def test_pieces_are_the_rendered_conversation(spark):
    form = chat.template("<s>" + chat.DEFAULT + "</s>")
    turns = [{"role": ("user", "assistant")[k % 2], "text": HARD[k]} for k in range(len(HARD))]
    table = spark.createDataFrame([(1, k, t["role"], t["text"]) for k, t in enumerate(turns)], SCHEMA)
    pieces = chat.format_turns(table, form)
    text, spans = form.render(turns)
    ordered = pieces.orderBy("section", "turn").collect()
    assert "".join(r.piece for r in ordered) == text
    assert [unescape(text[a:b]) for a, b in spans] == HARD[1::2] == [unescape(r.piece[a:b]) for r in ordered for a, b in zip(r.starts, r.ends, strict=True)]
    assert chat.digests(pieces, form).first().formatted_chars == len(text)


def test_empty_table(spark):
    assert chat.digests(chat.format_turns(spark.createDataFrame([], SCHEMA))).collect() == []


def test_planted_conversation(spark):
    row = next(r for r in chat.digests(chat.format_turns(chat.with_planted(spark.createDataFrame([], SCHEMA)))).collect())
    text = chat.PLANTED[1]
    assert (row.conv_id, row.n_turns, row.loss_chars, row.loss_sha256) == (-7, 2, len(text), sha(text))
    assert row.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n")


def test_no_control_string_stands_unescaped():
    form = chat.template()
    for text in HARD:
        written, _ = form.write({"role": "user", "text": text})
        inner = written.removeprefix("### user: ").removesuffix("</turn>\n")
        assert unescape(inner) == text
        at = 0
        while at < len(inner):
            assert not inner.startswith(chat.CONTROLS, at)
            at += 2 if inner[at] == "\\" else 1
        assert escape(text, chat.CONTROLS) == inner


def test_constants_are_folded():
    form = Template("{% for t in turns %}{{ 'a' + 'b' | upper }}{% if not false and 'x' == 'x' %}c{% elif t.role %}d{% endif %}{# note #}{{ 1 }}{{ none }}{% if t.role != 'x' or true %}{{ t.role }}{% else %}e{% endif %}{% endfor %}!", ("</turn>",))
    assert len(form.body) == 2  # one text, and a choice whose test is not constant
    assert form.body[0].of.value == "aBc1"
    assert form.write({"role": "r"}) == ("aBc1r", [])
    assert form.render([{}, {"role": "q"}])[0] == "aBc1aBc1q!"


def test_choices_and_generations():
    form = Template("{% for t in turns %}{% if t.role == 'a' %}[{% generation %}{{ t.text | trim }}{% endgeneration %}]{% elif t.role == 'b' %}({{ t.text }}){% else %}-{% endif %}{% endfor %}", ("]",))
    assert form.render([{"role": "a", "text": " xé "}, {"role": "b", "text": "y"}, {}]) == ("[xé](y)-", [(1, 3)])


@pytest.mark.parametrize(
    "source",
    [
        "no loop", "{% for t in turns %}", "{% for t in other %}{% endfor %}", "{% for t in turns %}{{ t }}{% endfor %}", "{% for t in turns %}{{ t.__class__.__mro__ }}{% endfor %}", "{% for t in turns %}{{ open('x') }}{% endfor %}",
        "{% for t in turns %}{{ t.role | system }}{% endfor %}", "{% for t in turns %}{% if t.role %}{% endfor %}", "{% for t in turns %}{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}{% endfor %}", "{{ t.role }}{% for t in turns %}{% endfor %}",
        "{% for t in turns %}{% endif %}{% endfor %}", "{% for t in turns %}{% for u in turns %}{% endfor %}{% endfor %}", "{% for t in turns %}{{ t.role ; }}{% endfor %}", "{% for t in turns %}{{ t.role | escape(t.text) }}{% endfor %}", "{% import os %}{% for t in turns %}{% endfor %}",
    ],
)
def test_what_the_language_refuses(source):
    with pytest.raises(TemplateError):
        Template(source, ("</turn>",))


def test_fields_are_keys_only():
    assert Template("{% for t in turns %}{{ t.__class__ }}|{{ t.keys }}{% endfor %}", ("x",)).write({"text": "a"}) == ("|", [])


@pytest.mark.parametrize("source", ["{% for t in turns %}{{ t.text }}</turn>{% endfor %}", "{% for t in turns %}{{ t.text | escape }}{% endfor %}", "{% for t in turns %}{% if t.role %}a{% else %}b{% endif %}{{ t.text | escape }}</turn>{% endfor %}"])
def test_what_can_not_be_read_back(source):
    with pytest.raises(TemplateError):
        Template(source, ("</turn>",)).reader()


def test_long_texts_take_linear_time(spark):
    form = chat.template()
    for text in ("#" * 400_000, "</turn" * 60_000, "\\" * 400_000):
        piece, _ = form.write({"role": "user", "text": text})
        assert unescape(form.reader().fullmatch(piece)["text"]) == text
