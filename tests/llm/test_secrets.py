import hashlib
import random
import re

from callmeter.llm import queries, secrets

SF = "/root/testdata/sf0.001"


def plain(text):
    """The three kinds by the letter: runs found character by character, then too short ones dropped."""
    out = []
    at = 0
    while at < len(text):
        m = re.match(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text[at:])
        if m and len(m[2]) >= 6:
            out.append((at, 0, "assign", at + m.end()))
        at += m.end() if m else 1
    for k, (kind, head, chars, least) in enumerate([("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)], 1):
        at = 0
        while at < len(text):
            end = at + len(head)
            if text.startswith(head, at):
                while end < len(text) and text[end] in chars:
                    end += 1
            if text.startswith(head, at) and end > at + len(head):
                if end - at >= least:
                    out.append((at, k, kind, end))
                at = end
            else:
                at += 1
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)]


def test_base_kinds_against_a_plain_scan():
    rng = random.Random(1)
    parts = ["password", "PassWD", "secret", "token", "API_KEY", "apikey", "AKIA", "ABCDEFGH12345678", "K", "ſ", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "deadbeef", "é", "\n", "x", "/+"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.joined(secrets.base_spans(text)) == ",".join(plain(text)), repr(text)


def found(text):
    return [text[s.start:s.end] for s in sorted(secrets.scan_text(text)[1], key=lambda s: s.start)]


def test_lexer_reads_pairs_of_source_and_configuration():
    pairs = {(p.name, p.value) for p in secrets.pairs("""export DB_HOST="db.local"
user: admin
"auth": "Bearer abc"
const x: string = 'typed'
<port>5432</port>
map["k"] = `v v`
a == b""")}
    assert pairs >= {("DB_HOST", "db.local"), ("user", "admin"), ("auth", "Bearer abc"), ("x", "typed"), ("port", "5432"), ("k", "v v")}


def test_lexer_adds_literals_of_sensitive_names_only():
    assert found('db_pwd = "hunter2!Zq81mX"') == ["hunter2!Zq81mX"]
    assert found("<clientSecret>9fQ!kd83jsL0$w</clientSecret>") == ["9fQ!kd83jsL0$w"]
    assert found('color = "hunter2!Zq81mX"') == []
    assert found('db_pwd = "${DB_PWD}"') == [] and found("credentials: none") == []
    assert found("the key: everything is plain prose here") == []


def test_constants_are_propagated_to_the_place_of_the_literal():
    text = 'part = "xK9!mQ2#vB"\nother = "7pL&zR"\ncredential = part + other\n'
    assert found(text) == ["xK9!mQ2#vB", "7pL&zR"]


def test_no_literal_is_lost_however_many_join():
    words = [f"Zq{i:03d}!xK" for i in range(100)]
    assert found("credential = " + " + ".join(f'"{w}"' for w in words)) == words
    lines = 'x = "aB3!dE5?"\n' + "".join(f'x = x + "{w}"\n' for w in words + words[:50]) * 2 + "db_pwd = x\n"
    assert len(found(lines)) == 301
    doubled = 'y = "Ab1!Cd2?"\n' + "y = y + y\n" * 300 + "db_pwd = y\n"
    assert found(doubled) == ["Ab1!Cd2?"]
    long = "Kq7!" * 40_000
    assert found(f'db_pwd = "{long}"') == [long] and found('db_pwd = "' + "x" * 100_000 + '"') == []


def test_profiles_add_up_to_that_of_the_whole_value():
    rng = random.Random(5)
    parts = ["", " ", "x", "X" * 40, "*" * 70, ".", "<", ">", "${", "$", "}", "{{", "}}", "your_", "example", "a b", "w_1" * 30, "\t", "é", "none", "change_me", "word " * 20]
    for _ in range(4000):
        own = [rng.choice(parts) for _ in range(rng.randint(1, 5))]
        v, p = "".join(own), secrets.Pair("n", [(t, 0, 0) for t in own], False).profile
        assert p.length == len(v) and p.chars == secrets.Counter(v) and p.between == (" " in v.strip()), own
        assert p.placeholder() == bool(secrets.PLACEHOLDER.match(v)), own


def test_base_spans_are_not_reported_twice():
    text = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    base, more = secrets.scan_text(text)
    assert [s.kind for s in sorted(base, key=lambda s: s.start)] == ["assign", "hex"] and not more


def test_long_texts_take_linear_time():
    for part in ("a", "a.", "token ", "x=", 'x="', "a+", "AKIA", "f", '"a"+', "<a>", "password  ", "x = x + x\n", 'key_pwd = key_pwd + "aB3!"\n', "pwd = pwd + pwd\n"):
        secrets.scan_text(part * (400_000 // len(part)))


def test_whole_table_and_edge_cases(spark, docs):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op3_secret_scan"](spark, SF).collect():
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) | {""}
    d = docs([(None, None), (1, ""), (2, "é token=abcdef"), (2, "é token=abcdef")])
    rows = sorted((str(r.doc_id), r.n_assign, r.spans) for r in secrets.scan(d).collect())
    assert rows == [("1", 0, ""), ("2", 1, "assign:2:14"), ("2", 1, "assign:2:14"), ("None", 0, "")]
    assert secrets.scan(d.limit(0)).count() == 0
