"""Further forms of assignments, and time in proportion to the length of odd texts."""

import time

import pytest

from ripplet.llm import secrets

SECRET = "Zx8kQ2vB7pQQ"


def found(text):
    return [text[a:b] for a, b, _ in secrets.literal_spans(text)]


@pytest.mark.parametrize(
    "form",
    [
        'user, pwd = "bob", "%s"', 'user, pwd := "bob", "%s"', 'let user, pwd = "bob", "%s";', 'x = 1\npwd, user = "%s", "bob"\n', "#define DB_PWD \"%s\"", "# define\tDB_PWD '%s'\nint x;", 'pwd <- "%s"', 'set pwd "%s"', "SET pwd '%s'", "setenv DB_PASSWORD %s",
        'setPwd("%s")', 'config.setPassword("%s");', 'set_db_password("%s")', 'builder().withPassword("%s").build()', 'map.put("password", "%s")', 'props.setProperty("db.password", "%s");', 'define("DB_PASSWORD", "%s");', 'conf.set("x.secret", "%s")',
        'password:\n  "%s"', 'password =\n    "%s"\n', 'password: |\n', 'postgres://bob:%s@host/db', "url = 'https://u:%s@example.com/x?y=1'", '\\"password\\": \\"%s\\"', "{\\'db_pwd\\': \\'%s\\'}", 'password = \\\n  "%s"',
    ],
)
def test_forms(form):
    assert found(form.replace("%s", SECRET)) == ([SECRET] if "%s" in form else [])


@pytest.mark.parametrize(
    "text",
    [
        f'a, b = "{SECRET}", "{SECRET}"', f'user, pwd = "{SECRET}", other', 'class Token:\n    """The Docs of 12 tokens, it is fine."""', "if token:\n    'Zx8 is 7 No'\n", "password:\nuser: bobby12345", f'password:\n\n"{SECRET}"', f'setName("{SECRET}")',
        f'map.put("name", "{SECRET}")', f'#define NAME "{SECRET}"', f'settle("{SECRET}")', "http://example.com/a:b@c", "see http://host:8080/path and me@x.org", f'f(token, "{SECRET}")', "password < -1", f'put("password")\nx = "{SECRET}"',
    ],
)
def test_no_secrets(text):
    assert found(text) == []


@pytest.mark.parametrize("unit", ['\\"', "\\`", "\\'", "<a", '"""', "'''", '"\'', "`x'", "a,", "set(", "set('a',", "://a:b", "://", "x:\n", "#define ", '{"password":', "pwd = \\\n", "a, b = ", "<a>b", '\\"a'])
def test_doubling_doubles(unit):
    took = []
    for n in (100_000, 400_000):
        text = "password = " + unit * (n // len(unit))
        began = time.monotonic()
        secrets.spans(text)
        took.append(time.monotonic() - began)
    assert took[1] < 8 and took[1] < 10 * max(took[0], 0.2)


def test_one_long_element_name():
    began = time.monotonic()
    secrets.spans("password <" + "a" * 400_000)
    assert time.monotonic() - began < 5
