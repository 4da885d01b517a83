import base64
import email.message
import quopri
import random

from lodequery.llm.mailtext import html_text, message_words, readable_text, words


def test_words():
    assert words("It's Élan_9, naïve—ok ÄÖ 3.5") == ["it", "s", "élan_9", "naïve", "ok", "äö", "3", "5"]


def test_html_shows_what_a_reader_sees():
    page = "<html><head><title>t</title><style>p {x}</style></head><body><!-- no --><p>Hel<b>lo</b> W&ouml;rld</p><div>a<br>b</div><script>no()</script>" \
        '<p style="display:none">no <b>no</b></p><span hidden>no</span>end</body></html>'
    assert words(html_text(page)) == ["hello", "wörld", "a", "b", "end"]
    assert words(html_text("<p>open <style>never closed")) == ["open"]


def test_parts_encodings_and_damage():
    b64 = base64.encodebytes("Grüße aus Köln".encode("iso-8859-1")).decode()
    qp = quopri.encodestring("café crème, long line that has to be wrapped because it is far beyond seventy-six".encode()).decode()
    message = (
        "From x Mon Sep 21\nSubject: not read\nContent-Type: multipart/mixed;\n\tboundary=\"=_00\"\n\npreamble no\n--=_00\nContent-Type: text/plain; charset=iso-8859-1\n"
        f"Content-Transfer-Encoding: base64\n\n{b64}\n--=_00\nContent-type: TEXT/plain\nContent-Disposition: attachment\nContent-Transfer-Encoding: quoted-printable\n\n{qp}\n"
        "--=_00\nContent-Type: multipart/alternative; boundary==_00x\n\n--=_00x\nContent-Type: text/html\n\n<p>in<i>ner</i></p>\n--=_00x--\nno epilogue\n"
        "--=_00\nContent-Type: message/rfc822\n\nSubject: no\n\nforwarded body\n--=_00\nContent-Type: application/pdf\n\nno pdf\n--=_00--\nepilogue no\n"
    )
    want = words("Grüße aus Köln café crème, long line that has to be wrapped because it is far beyond seventy-six inner forwarded body")
    assert message_words(message) == want
    assert message_words(message.replace("\n", "\r\n")) == want
    assert message_words(message.split("--=_00\nContent-Type: application")[0]) == want  # never closed
    assert message_words(message[:300]) and message_words("Content-Transfer-Encoding: base64\n\nYWJjZ") == ["abc"]
    assert message_words("Content-Type: text/plain; charset=nonsense\n\nbody") == ["body"]
    assert readable_text(None) == "" == readable_text("") and message_words("no header at all") == ["no", "header", "at", "all"]
    assert message_words("Subject: only a header") == [] and len(message_words("A: b\n\n" + "word " * 300_000)) == 300_000


def test_equals_the_standard_parser_on_plain_messages():
    rng = random.Random(1)
    for _ in range(50):
        m = email.message.EmailMessage()
        m["Subject"] = "s"
        m.set_content(" ".join(rng.choice(["été", "word", "x_1", "ß"]) for _ in range(rng.randrange(80))) + "\n", cte=rng.choice(["base64", "quoted-printable", "8bit"]))
        if rng.random() < 0.5:
            m.add_alternative("<p>shown <b>t</b>ext</p>", subtype="html")
        text = m.as_string() if m.get("Content-Transfer-Encoding") != "8bit" else m.as_bytes().decode()
        parts = [p.get_content() for p in m.walk() if p.get_content_type() == "text/plain"]
        got = message_words(text)
        assert got[: len(words(parts[0]))] == words(parts[0]) and len(got) - len(words(parts[0])) in (0, 2)


def test_parts_at_any_depth():
    text = "Subject: x\n\nthe innermost words\n"
    for i in range(200):
        kind = f'multipart/mixed; boundary="b{i}"' if i % 2 else "message/rfc822"
        body = f"--b{i}\n{text}\n--b{i}\n\nafter {i}\n--b{i}--\n" if i % 2 else text
        text = f"Content-Type: {kind}\n\n{body}"
    got = readable_text(text)
    assert "the innermost words" in got and got.index("innermost") < got.index("after 1\n") < got.index("after 199")
