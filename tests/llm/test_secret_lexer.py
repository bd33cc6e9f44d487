"""What the lexer takes for an assignment, and that a scan's time grows with the text only."""

import time

import pytest

from riskframe.llm import secret_lexer
from riskframe.llm.secret_lexer import scan, statements

VALUE = "q7Gh2kLm9Zx4"


def flows(text):
    return [text[s:e] for k, s, e, _ in scan(text) if k == "flow"]


@pytest.mark.parametrize(
    "text",
    [
        f'{{"passphrase":\n   "{VALUE}"}}',
        f"passphrase:\n  '{VALUE}'\n",
        f'passphrase = \\\n  "{VALUE}"',
        f'passphrase = """{VALUE}"""',
        f'passphrase: str = "{VALUE}"',
        f'def f(passphrase: str = "{VALUE}"): pass',
        f'passphrase = os.getenv("DB", "{VALUE}")',
        f'passphrase = f"{VALUE}"',
        f"<passphrase>{VALUE}</passphrase>",
        f'passphrase{" " * 500}= "{VALUE}"',
        f'config["passphrase"] = "{VALUE}"',
        f'BASE: str = "{VALUE}"\npassphrase = BASE',
        f"passphrase: {VALUE}",
        f'don\'t forget, passphrase = "{VALUE}"',
    ],
)
def test_literals_that_reach_a_sensitive_name(text):
    assert flows(text) == [VALUE]


@pytest.mark.parametrize(
    "text",
    [
        f'def login(passphrase: str): pass\ntitle: str = "{VALUE}"',
        f'note = "the passphrase = {VALUE}"',
        f'passphrase: str\nname = "{VALUE}"',
        f'{{"passphrase":\n "title": "{VALUE}"}}',
        f'title = os.getenv("passphrase", "{VALUE}")',
        f"<title>{VALUE}</title>",
        f'if passphrase == "{VALUE}": pass',
        "",
        '"""',
        "passphrase =",
    ],
)
def test_literals_that_do_not(text):
    assert flows(text) == []


def test_statements_of_a_text():
    text = "a: int = 1\nb = {'c': d}\nf(e=g)"
    assert [(name, [text[s:e] for _, s, e, _ in parts]) for _, name, parts in statements(text)] == [("a", ["1"]), ("c", ["d"]), ("e", ["g"])]


@pytest.mark.parametrize("unit", ['\\"', '"', "'''", "a = ", "a: b = ", "((", "<a>", "a" * 50 + ".", "x = y + ", "p:\n", "f('a', ", "`"])
def test_time_grows_with_the_text(unit):
    def seconds(n):
        text = "passphrase " + unit * n
        begun = time.process_time()
        secret_lexer.scan(text)
        return time.process_time() - begun

    assert seconds(40000) < max(0.5, 12 * seconds(10000))
