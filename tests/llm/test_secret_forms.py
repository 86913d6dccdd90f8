"""Secret scan: planted literals, work in proportion to the text, chains and repeated rows."""

import random
import time

import pytest

from quillstone.llm import secret_scan

FORMS = [
    (1, 'db_password = "{0}"'), (1, "'client_secret': '{0}',"), (1, "const apiKey = `{0}`;"), (1, 'private_key: str = "{0}"'), (2, 'SECRET_KEYS = ["{0}", "{1}"]'), (2, "tokens = ('{0}', '{1}')"), (2, 'password = (\n    "{0}"\n    "{1}"\n)'), (1, "password: |\n  {0}\nnext_key: 1"),
    (1, 'token = os.getenv("TOKEN_VAR", "{0}")'), (2, 'PART = "{0}"\npasswd = PART + "{1}"'), (1, 'first = "{0}"\nsecond = first\nauthToken = second'), (1, 'accesskey="{0}"'), (1, 'connect(user="bob", password="{0}")'), (1, 'credentials = {{"passphrase": "{0}"}}'),
]
PLAIN = ['name = "{0}"', "note: '{0}'", 'password_file = "{0}"', 'token = config.get("{0}")', 'items = ["{0}"]', "if a == '{0}': pass", "plain words {0} here"]


def test_finds_planted_literals_and_no_others():
    """Independent of the lexer: texts are made from statements whose literals are known."""
    rng = random.Random(21)

    def secret():
        return "".join(rng.choice("abcdefghkmnpqrstuvwxyz") for _ in range(5)) + str(rng.randrange(1000, 9999)) + rng.choice("!?*") + "Zq"

    for _ in range(80):
        text, want = "", []
        for _ in range(rng.randrange(1, 12)):
            n, form = rng.choice(FORMS) if rng.random() < 0.6 else (0, rng.choice(PLAIN))
            values = [secret(), secret()]
            line = form.format(*values) + "\n"
            want += [(len(text) + line.index(v), len(text) + line.index(v) + len(v)) for v in values[:n]]
            text += line
        assert secret_scan.literal_spans(text) == sorted(want), text


@pytest.mark.parametrize("unit", ["a=b&", "a=", "password:abc1:", "password='\\'", "password=(\n", "password=[", "x='''a", "x=\"b='c\" "])
def test_time_grows_with_the_text(unit):
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        secret_scan.scan(unit * (n // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.2  # eight times the text: with its square it would take 64 times as long


def test_chains_and_repeated_rows(spark):
    chain = "\n".join(f"password{i} = password{i - 1} + 'x{i}abcd9'" for i in range(1, 3001))
    assert len(secret_scan.literal_spans(chain)) == 3000
    out = secret_scan.secret_spans(spark.createDataFrame([(1, 'token = "ab12-cd34!"')] * 3 + [(None, None)], "doc_id long, text string")).collect()
    assert len(out) == 4 and len({(r.doc_id, r.spans) for r in out}) == 2
