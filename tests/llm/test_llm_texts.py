"""Operators on single texts, each against brute force or its library, with the cases that its docstring defines."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from gustline.llm import chat_format, html_text, language, pii, secret_ledger, token_counts
from gustline.llm.staging import Staging
from gustline.llm.words import SPACED, parts, shingle_sets, text_bytes, words_of

def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for name in ("_digest", "key", "class", "n", "_own0", "score", "row", "_blob", "kind", "_edits", "token", "id"):
            df = df.withColumn(name, F.lit("x"))
    return df


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_words_and_sets_match_strings():
    texts = ["", "A b\tA b\nA b", "one", None, " \r\n", "é É x y z " * 40, "w" * 5000]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    for limit in (1, 50, 1 << 20):
        sizes, counts = [], []
        for a, b in parts(offsets, limit):
            words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACED)
            counts += words.counts.tolist()
            sizes += np.diff(shingle_sets(words, 4)[1]).tolist()
        lists = [re.findall(r"[^\x20\x09-\x0d]+", (t or "").replace("A", "a")) for t in texts]
        assert counts == [len(w) for w in lists]
        assert sizes == [len({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))}) if w else 0 for w in lists]


def test_tokens_match_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    random.seed(3)
    parts_ = ["a", "b", "s", "t", "r", "e", "v", "l", "d", "'", "'", " ", " ", "\n", "\t", "1", "é", "!", "<|endoftext|>", "中",
              "🙂", "the", "ing", "'s", "'re", "'ll", " ", "²", "\r\n", "́"]
    texts = ["".join(random.choice(parts_) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, "ab" * 30000, " " * 20001 + "x", "'" * 9000 + "re", "<|endoftext|>" * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (0, texts[0])]
    got = token_counts.count_tokens(documents(spark, rows))
    expected = [
        (i, len((t or "").encode()), n, n > 1024)
        for (i, t), n in ((r, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    ]
    assert table(got) == sorted(expected, key=str)
    assert token_counts.count_tokens(documents(spark, [])).count() == 0


def test_chunk_maps_give_the_states_of_one_walk():
    random.seed(5)
    classes = np.array([random.randrange(token_counts.CLASSES) for _ in range(5000)], np.uint8)
    offsets = np.array([0, 0, 17, 2000, 2001, 5000])
    whole = token_counts.split_marks(classes, offsets, 1 << 20)
    for chunk in (1, 2, 3, 64, 999):
        assert (token_counts.split_marks(classes, offsets, chunk) == whole).all()


def conversation(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("turns", F.lit("x")).withColumn("loss", F.lit(1)).withColumn("formatted", F.lit(None))


def test_chat_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "~0~1<+>", "<s>[user]", "", None, "~", "]]", "\n", "<" * 300, "x" * 50000, "é\\1$1"]
    rows = [(1, i, random.choice(["user", "assistant", None, "a]b"]), t) for i, t in enumerate(nasty * 3)]
    rows += [(2, 0, "assistant", "only"), (3, 5, "user", "tie"), (3, 5, "user", "tie"), (3, 5, "assistant", "tie"), (None, 1, "user", "n")]
    rows += [(4, i, "assistant", f"{i}<+>") for i in range(500)]
    formatted = chat_format.format_conversations(conversation(spark, rows))
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert set(back) == {1, 2, 3, 4, None}
    for key, r in back.items():
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == key))
        assert [(t.role, t.text) for t in r.turns] == [(b, c) for _, b, c in turns]
        assert list(r.learned) == [c for _, b, c in turns if b == "assistant"]
        changes = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert r.formatted.count("</s>") == changes
    one = {r.conv_id: r for r in chat_format.digest(formatted).collect()}[3]
    assert one.turns_sha256 == hashlib.sha256(b"assistant\ntie\nuser\ntie\nuser\ntie\n").hexdigest()
    assert (one.n_turns, one.loss_chars) == (3, 3)
    assert chat_format.format_conversations(conversation(spark, [])).count() == 0


def brute_secrets(text):
    rules = {
        "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile("[0-9a-f]+"), 0, 24),
    }
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(rules.items()):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(found)]


SECRETS = [
    (1, "token = abc secret=token: abcdefgh password==abcdef"),
    (2, "é🙂 API_KEY: 'aaaaaa' apikey=\"bbbbbbb\" AKIA" + "A" * 16 + " " + "0a" * 12 + "z" + "f" * 23),
    (3, None), (4, ""), (5, "PassWord='" + "x" * 70000), (6, "token = " + "ab" * 20), (6, "token = " + "ab" * 20),
    (None, "secret: abcdef"), (7, "AKIAAKIA" + "Z9" * 10 + "secret = \n abcdef"),
]


def test_secrets_match_brute_force(spark):
    found, ledger = secret_ledger.scan_versions(documents(spark, SECRETS))
    got = sorted(((r.doc_id, [tuple(s) for s in r.found]) for r in found.collect()), key=str)
    assert got == sorted(((i, brute_secrets(t)) for i, t in SECRETS), key=str)
    assert "_own0" in found.columns and "_blob" in found.columns
    empty, _ = secret_ledger.scan_versions(documents(spark, []))
    assert empty.count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    staging = Staging(spark)
    docs = documents(spark, SECRETS)
    _, ledger = secret_ledger.scan_versions(docs, staging=staging)
    assert ledger.count() == 3 * len({t or "" for _, t in SECRETS})
    again = secret_ledger.scan_unseen(docs, ledger, secret_ledger.RULES, Staging(spark))
    assert again.count() == 0
    newer = [*secret_ledger.RULES[:2], secret_ledger.Rule("hex", 2, "[0-9a-f]{30,}", 30)]
    fresh = secret_ledger.scan_unseen(docs, ledger, newer, Staging(spark))
    assert {(r.kind, r.version) for r in fresh.select("kind", "version").distinct().collect()} == {("hex", 2)}
    more = documents(spark, [(9, "secret: abcdef"), (10, "token: new-one")])
    found, grown = secret_ledger.scan_versions(more, ledger, staging=Staging(spark))
    assert grown.count() == ledger.count() + 3
    assert {r.doc_id: [tuple(s) for s in r.found] for r in found.collect()} == {
        9: [("assign", 0, 14)], 10: [("assign", 0, 14)]
    }


def test_surrogates(spark):
    text = (
        "Mr John Smith met Mrs Smith, Jo.Doe@Web.de and jo.doe@web.de, card 4111 1111 1111 1111 or 4111111111111111; "
        "IBAN DE89370400440532013000, call (743) 555-3824, 10.1.2.3. Госпожа Анна Петрова"
    )
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "Mr Smith at JO.DOE@WEB.DE!"), (None, "ip 8.8.8.8"), (5, "clean " * 9000)]
    rows += [(100 + i, f"+1 (212) 555-{i:04d} a{i}@b.org {i}.{i}.{i}.{i}") for i in range(1, 250)]
    got = pii.replace(documents(spark, rows), b"key").select("doc_id", "text", "n_entities", "spans").collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    assert found[2].text is None and found[3].text == "" and found[5].text == "clean " * 9000
    new = found[1].text
    for old in ("John", "Smith", "Doe", "4111", "3704", "743) 555-3824", "1.2.3", "Анна", "Петрова"):
        assert old not in new
    title, given, surname = new.split()[:3]
    assert given in pii.GIVEN["m", "latin"].split() and new.split()[5].rstrip(",") == surname
    assert found[4].text.split()[1] == surname
    mails = re.findall(r"\S+@\S+[a-z]", new)
    assert mails[0].lower() == mails[1] == found[4].text.split()[3].rstrip("!").lower() and mails[0][0].isupper()
    cards = re.search(r"card ([\d ]{19}) or (\d{16})", new)
    assert cards[1].replace(" ", "") == cards[2] and pii._luhn(cards[2]) == 0
    iban = re.search(r"DE\d{20}", new)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "10." in new and re.search("Госпожа [А-Я][а-я]+ [А-Я][а-я]+$", new)
    originals = {v for _, t in rows if t for _, _, k, v in pii.find(t)}
    per_kind = {}
    for i in range(1, 250):
        for k, part in zip(("phone", "email", "ip"), re.match(r"(\S+ \S+ \S+) (\S+) (\S+)", found[100 + i].text).groups()):
            per_kind.setdefault(k, set()).add(part)
            assert part not in originals
    assert all(len(v) == 249 for v in per_kind.values())
    assert pii.replace(documents(spark, []), b"key").count() == 0
    assert "_own0" in pii.replace(documents(spark, rows[:2]), b"key").columns


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Anna Mueller said", "Anna Mueller"), ("Mr John Smith. SMITH said Smith's", "John Smith SMITH Smith"),
        ("Mr McDonald, Mr O'Brien", "McDonald O'Brien"), ("Mr J. Smith", "J Smith"), ("Herr Kovačič-Žák", "Kovačič Žák"),
        ("MR JOHN SMITH", "JOHN SMITH"), ("Herr von Braun", "Braun"), ("Frau Παπαδοπούλου", "Παπαδοπούλου"),
    ],
)
def test_names_in_any_form(text, names):
    assert [text[s:e] for s, e, *_ in pii.find(text)] == names.split()


def test_a_name_keeps_its_surrogate(spark):
    rows = [(1, "Dr Anna Novak. Later Novak spoke"), (2, "Frau Anna Novak"), (3, "FRAU ANNA NOVAK"), (4, "x +12233"), (5, "Anna Novak")]
    rows += [(6, "call +12233 or a@b.org"), (7, "Mr J. Novak")]
    got = {r.doc_id: r.text for r in pii.replace(documents(spark, rows), b"key").collect()}
    given, surname = got[5].split()
    assert "Anna" != given in pii.GIVEN["f", "latin"].split() and surname != "Novak"
    assert got[1] == f"Dr {given} {surname}. Later {surname} spoke" and got[2] == f"Frau {given} {surname}"
    assert got[3] == f"FRAU {given} {surname}".upper() and got[7][4] == "." and got[7].endswith(f". {surname}")
    assert got[4].split()[1] == got[6].split()[1] != "+12233"


def test_surrogates_that_collide_draw_again(spark):
    names = [f"Abel{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    entities = spark.createDataFrame([("surname_latin", n) for n in [*names, "Baker", "Quinn"]], "kind string, value string")
    got = pii.assign(entities, b"key", Staging(spark)).collect()
    assert len({r.surrogate for r in got}) == len(got) == 122
    assert not {r.surrogate for r in got} & {r.value for r in got}


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body class="sidebar">
<header>Site {n}</header><div class="menu"><a href="/">Home</a></div>{main}<aside>side</aside><footer>&copy; {n}</footer></body>"""


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumn("host", F.lit(1)).withColumn("shape", F.lit(1)).withColumn("blocks", F.lit("x"))


def test_pages_with_an_article(spark):
    article = (
        "<main><div class='notice'>Cookies</div><article><header><h1>T {n}</h1></header><p>One <a>two</a>\n three&lt; &amp;"
        "<br>four<p>Five {n}<p>Licensed<form>f</form><div id=comments><p>reader</p></div><ul><li>a<li>b</ul>tail</article></main>"
    )
    rows = [(i, f"http://H.org/{i}", PAGE.replace("{main}", article).replace("{n}", str(i))) for i in range(4)]
    rows += [(9, None, None), (10, "x", ""), (11, "http://h.org", "<p>a < b"), (rows[0]), (None, "http://h.org/z", "<b>b</b> c <script>x")]
    got = {r.page_id: r for r in html_text.extract(pages(spark, rows)).collect()}
    for i in range(4):
        expected = [f"T {i}", "One two three< & four", f"Five {i}", "Licensed", "a", "b", "tail"]
        assert got[i].text == "\n\n".join(expected) and got[i].n_chars == len(got[i].text)
    assert got[9].text == got[10].text == "" and got[11].text == "a < b" and got[None].text == "b c"
    assert html_text.extract(pages(spark, rows)).count() == len(rows)
    assert html_text.extract(pages(spark, [])).count() == 0


def test_template_of_a_host_without_markers(spark):
    """Only the alignment tells the repeated lines from the texts."""
    body = "<body><div><div>Welcome to us</div><div>{a}</div><section><p>{b}</p></section><div>All rights</div></div></body>"
    rows = [(i, f"https://a.net/{i}", body.format(a=f"Lead {i}", b=f"Body {i}")) for i in range(5)]
    rows += [(7, "https://lone.net/", body.format(a="x", b="y"))]
    for parts_ in (1, 3):
        got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows), parts_ + 1).collect()}
        assert [got[i] for i in range(5)] == [f"Lead {i}\n\nBody {i}" for i in range(5)]
        assert got[7] == "Welcome to us\n\nx\n\ny\n\nAll rights"


def test_names_of_any_script_and_form(spark):
    rows = [
        (1, "Herr Δημήτριος Παπαδόπουλος kam. Παπαδόπουλος ging."),
        (2, "J. Smith came. C. Smith and E. Smith met Mr J. Smith."),
        (3, "Mr Müller-Lüdenscheidt met Frau Anna-Maria Schmidt."),
        (4, "fe80::1ff:fe23:4567:890a, 2001:0db8:85a3:0000:0000:8a2e:0370:7334 but std::vector<int> a::b, 10:30:15"),
        (5, "born on 12.03.1980, DOB: 1975-02-28, met on 12.03.1980"),
    ]
    got = {r.doc_id: r.text for r in pii.replace(documents(spark, rows), b"key").collect()}
    first, last = re.findall(r"\w+", got[1])[1:3]
    assert all("\u0370" <= c < "\u0400" or "\u1f00" <= c < "\u2000" for c in first + last)
    assert got[1].endswith(f"{last} ging.") and "Δημήτριος" not in got[1] and "Παπαδόπουλος" not in got[1]
    j, c, e, again = re.findall(r"(\w)\. \w+", got[2])
    assert j == again and len({j, c, e}) == 3 and "Smith" not in got[2]
    parts = re.fullmatch(r"Mr (\w+)-(\w+) met Frau (\w+)-(\w+) (\w+)\.", got[3]).groups()
    assert parts[2] in pii.GIVEN["f", "latin"].split() and parts[0] not in pii.GIVEN["m", "latin"].split()
    assert "std::vector<int> a::b, 10:30:15" in got[4] and "fe80" not in got[4] and "2001:0db8" not in got[4]
    assert re.fullmatch(r"[0-9a-f]{4}::[0-9a-f]{3}(:[0-9a-f]{4}){3}", got[4].split(",")[0])
    assert got[5].endswith("met on 12.03.1980") and "1975-02-28" not in got[5]
    day, month, year = re.match(r"born on (\d\d)\.(\d\d)\.(\d{4}),", got[5]).groups()
    assert 1 <= int(day) <= 28 and 1 <= int(month) <= 12 and 1975 <= int(year) <= 1985


def test_mentions_stay_apart_and_together(spark):
    """Over all mentions of many names: equal ones become equal, unlike ones stay unlike, and none is left."""
    r = random.Random(14)
    surnames = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)).capitalize() for _ in range(120)]
    rows = [(i, f"Mr {n} came, {n} said; {n.upper()} wrote to a{i % 40}@x.org.") for i, n in enumerate(surnames * 2)]
    got = {x.doc_id: x.text for x in pii.replace(documents(spark, rows), b"k2").collect()}
    into: dict = {}
    for i, old in rows:
        m = re.fullmatch(r"Mr (\w+) came, (\w+) said; (\w+) wrote to (\S+)\.", got[i])
        assert m[1] == m[2] and m[1].upper() == m[3]
        into.setdefault(old.split()[1], set()).add(m[1])
        into.setdefault(old.split()[-1], set()).add(m[4])
    assert all(len(v) == 1 for v in into.values())
    assert len({next(iter(v)) for v in into.values()}) == len(into)
    assert not set(into) & {x for v in into.values() for x in v}


def text_of_page(source):
    return "\n\n".join(t for *_, t in html_text.candidates(html_text.parse(source)))


def test_names_only_hint():
    """Whole names count, and not against a page that would be empty without them."""
    assert text_of_page("<body><form action=x><nav>m</nav><h1>Title</h1><p>All of it</p></form>") == "Title\n\nAll of it"
    assert text_of_page("<div class='site-content has-sidebar'><p>Text</p><div class=sidebar>side</div></div>") == "Text"
    assert text_of_page("<section id=form-validation><h2 id=social-history>H</h2><p>T</p></section>") == "H\n\nT"
    assert text_of_page("<div class='article-login-guide'><p>Log in</p></div><div class=login-form>name</div>") == "Log in"
    assert text_of_page("<div class=sidebar><div class=post><h1>T</h1><p>Body</p></div><div class=ad>x</div></div>") == "T\n\nBody"
    assert text_of_page("<article><p>a</p></article><p>between</p><article><p>much longer b</p></article>") == "a\n\nmuch longer b"
    assert text_of_page("<form><article><p>in a form</p></article><input><button>Go</button></form>") == "in a form"
    assert text_of_page("<p>few</p><div id=comments>" + "<p>many readers write</p>" * 3 + "</div>") == "few"
    assert text_of_page("<div class=site-header>name</div><div class=cookie-notice>c</div><p>t</p><footer>f</footer>") == "t"


def test_ids_of_single_pages_are_no_label():
    one, two = (html_text.parse(f"<div id='post-{i}' class='item{i} post'><p>x</p></div>") for i in (17, 18))
    assert one.shape() == two.shape() and "div.post" in one.labels


def generated_host(r, n):
    """Pages without any telling tag or name: constant blocks at fixed places, and what each page says."""
    out = []
    for i in range(n):
        own = [f"lead {i} {r.random()}"] + [f"text {i} {j} {r.random()}" for j in range(r.randint(1, 12))]
        blocks = ["<div><div>Welcome</div><div>About us</div></div>"]
        blocks.append("<section>" + "".join(f"<div>{t}</div>" for t in own) + "</section>")
        blocks += ["<div><p>Terms apply</p></div>"] + ["<div><span>Partner site</span></div>"] * (i % 3 == 0)
        out.append(("<body>" + "".join(blocks) + "</body>", own))
    return out


def test_generated_hosts_against_brute_force(spark):
    """What most pages of a host share goes and what differs stays, by nothing but the alignment."""
    r = random.Random(21)
    hosts = {f"h{k}.example": generated_host(r, 24) for k in range(4)}
    rows = [(100 * k + i, f"http://{h}/{i}", p) for k, (h, made) in enumerate(hosts.items()) for i, (p, _) in enumerate(made)]
    rows += [(900 + i, f"http://h0.example/copy{i}", rows[1][2]) for i in range(30)]  # copies of one page make nothing common
    for fan in (2, 32):
        got = {x.page_id: x.text for x in html_text.extract(pages(spark, rows), fan).collect()}
        for k, made in enumerate(hosts.values()):
            for i, (_, own) in enumerate(made):
                assert got[100 * k + i] == "\n\n".join(own)
        assert all(got[900 + i] == got[1] for i in range(30))


def test_long_lists_of_siblings_are_aligned():
    """Far more siblings than can be weighed pair by pair, in linear time."""
    def tree(n, label):
        inner = [html_text.Node(label if i % 7 else "x", 0, 0, 1) for i in range(n)]
        return html_text.Node("r", 0, 0, 1, [html_text.Node("head", 0, 0, 1), *inner, html_text.Node("foot", 0, 0, 1)])

    a, b = tree(5000, "div"), tree(5200, "div")
    weight, pairs = html_text.match(a, b)
    assert weight == len(pairs) >= 4900 and {("head", "head"), ("foot", "foot")} <= {(x.label, y.label) for x, y in pairs}
    assert len(html_text.merge(a, b).children) <= 5400


@pytest.mark.parametrize("quote", ['"', "'"])
def test_attributes_of_any_length(quote):
    """Markup in a tag is never text, and what a tag holds apart stays apart."""
    value = quote + "A1<b> " * 3000 + quote
    source = (
        f"<p>a</p><div data-x={value} class=ad>advert</div><img src={value}><script data-x1={value}>var a</script>"
        f"<nav data-x={value}>menu</nav><div title={value}>b</div><p title=it's>c</p><p hidden>no</p><p alt='hidden'>d</p>"
    )
    assert [t for *_, t in html_text.candidates(html_text.parse(source))] == ["a", "b", "c", "d"]
    cut = html_text.parse(f"<p>a<div data-x={quote}AAAA>b</div><p>c < d")
    assert [t for *_, t in html_text.candidates(cut)] == ["a", "b", "c < d"]
    assert html_text.parse("<p>x" + f"<i a={quote}" * 20000).blocks


def test_pages_of_any_depth(spark):
    """Unclosed elements nest deeper than Python calls do."""
    deep = "<div>Welcome" + "<div>" * 3000
    rows = [(i, f"http://d.org/{i}", f"<body>{deep}Text {i}") for i in range(3)] + [(3, "http://d.org/3", "<body><div>Welcome<p>Text 3")]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Text {i}" for i in range(4)}
    tree = html_text.Node("a", 0, 1, 2, [html_text.Node("b", 0, 0, 1, [html_text.Node("c", 1, 1, 1)]), html_text.Node("d", 0, 0, 2)])
    assert html_text.Node.unpack(tree.pack()) == tree


def test_simple_tree_matching():
    def tree(label, *inner):
        return html_text.Node(label, 0, 0, 1, list(inner))

    a = tree("r", tree("a", tree("x")), tree("b"), tree("c", tree("y"), tree("z")))
    b = tree("r", tree("b"), tree("q"), tree("c", tree("z")), tree("a"))
    weight, pairs = html_text.match(a, b)
    assert weight == len(pairs) == 4
    assert html_text.match(tree("r"), tree("s")) == (0, [])
    merged = html_text.merge(a, b)
    assert [c.label for c in merged.children] == ["a", "b", "q", "c", "a"]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_held_out_accuracy(spark, labelled):
    found = language.identify(labelled.withColumn("score", F.lit("x")))
    rows = {r.doc_id: r for r in found.collect()}
    truth = {r.doc_id: r.lang for r in labelled.collect()}
    held = [i for i in truth if rows[i].held_out]
    crc = duckdb.connect()  # the split is a fixed rule
    assert 100 < len(held) < 300 and crc is not None
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) >= 0.98
    assert np.mean([rows[i].rejected for i in held]) <= 0.02
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(labelled).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in rows.items()}


FOREIGN = """Всички хора се раждат свободни и равни по достойнство и права и са надарени с разум и съвест
すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられている
人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。
Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten
Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem
Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki
Ὅλοι οἱ ἄνθρωποι γεννιοῦνται ἐλεύθεροι καὶ ἴσοι στὴν ἀξιοπρέπεια καὶ τὰ δικαιώματα
يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا
सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है
모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다
Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler""".splitlines()


def test_language_rejects_what_it_never_learned(spark, labelled):
    r = random.Random(12)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.randint(100, 2000))) for _ in range(10)]
    junk += [base64.b64encode(r.randbytes(r.randint(80, 4000))).decode() for _ in range(10)]
    model = language.train(labelled.filter(~language.held_out()).select("text", "lang"))
    got = language.predict(documents(spark, list(enumerate(FOREIGN + junk))), model, ["doc_id"]).collect()
    assert np.mean([x.rejected for x in got if x.doc_id < len(FOREIGN)]) >= 0.9
    assert np.mean([x.rejected for x in got if x.doc_id >= len(FOREIGN)]) >= 0.9


def test_rare_languages_are_learned(spark, labelled):
    """A language with a thousandth of the rows has its part of the sample."""
    rare = [(90000 + i, " ".join(r.choice("ψω χρο θεν λυσ μαρ").strip() + r.choice("ηθος ικα") for _ in range(40)), "el")
            for i in range(30) for r in [random.Random(i)]]
    both = labelled.select("doc_id", "text", "lang").union(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    found = {x.doc_id: x for x in language.identify(both, rows=400).collect()}
    held = [i for i, *_ in rare if found[i].held_out]
    assert held and all(found[i].lang_pred == "el" for i in held)


def test_language_cases(spark, labelled):
    model = language.train(labelled.select("text", "lang"), rows=400)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the and of the thing"), (4, "the and of the thing"), (None, "é"), (5, "der die und " * 40000)]
    got = {r.doc_id: r for r in language.predict(documents(spark, rows), model, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[4].lang_pred == "en" and got[5].lang_pred == "de" and 0 < got[5].score <= 1
    assert got[None].lang_pred in model.languages
    nothing = language.train(labelled.filter("false").select("text", "lang"))
    assert {r.lang_pred for r in language.predict(documents(spark, rows), nothing, ["doc_id"]).collect()} == {"und"}
    empty = documents(spark, []).withColumn("lang", F.lit("en"))
    assert language.identify(empty).count() == 0 and language.recognised(empty).columns == empty.columns


def _plain_match(x, y):
    """Nodes shared and the pairs, by the whole table of every two nodes."""
    if x.label != y.label:
        return 0, []
    inner = [[_plain_match(c, d) for d in y.children] for c in x.children]
    m, n = len(x.children), len(y.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + inner[i - 1][j - 1][0])
    pairs, i, j = [(x, y)], m, n
    while i and j:
        if inner[i - 1][j - 1][0] and best[i][j] == best[i - 1][j - 1] + inner[i - 1][j - 1][0]:
            pairs += inner[i - 1][j - 1][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs


def test_siblings_are_aligned_alike_however_many():
    rng = random.Random(3)
    def tree(depth, most):
        inner = [tree(depth - 1, 4) for _ in range(rng.randrange(most))] if depth else []
        return html_text.Node(rng.choice("aab"), 0, 0, 1, inner)

    cases = [(tree(3, 7), tree(3, 7)) for _ in range(200)]
    for size in (150, 260):  # below and above 40,000 pairs
        cases.append(tuple(html_text.Node("r", 0, 0, 1, [tree(1, 3) for _ in range(size + k)]) for k in (0, 9)))
    for a, b in cases:
        weight, pairs = html_text.match(a, b)
        expected, found = _plain_match(a, b)
        assert weight == expected
        assert {(id(x), id(y)) for x, y in pairs} == {(id(x), id(y)) for x, y in found}


def test_unlike_lists_of_thousands_of_siblings_are_aligned():
    rng = random.Random(4)
    def tree(n):
        return html_text.Node("r", 0, 0, 1, [html_text.Node(rng.choice("abc"), 0, 0, 1, [html_text.Node("x", 0, 0, 1)] * rng.randrange(4)) for _ in range(n)])

    a, b = tree(3000), tree(3100)
    weight, pairs = html_text.match(a, b)
    assert weight == len(pairs) > 3000
