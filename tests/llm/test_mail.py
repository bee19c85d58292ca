import base64
import email.policy
from email.message import EmailMessage

from jsonloom.llm import mail


def raw(headers, body):
    return "\n".join(headers) + "\n\n" + body


def test_encodings_and_charsets():
    for encoding, charset in (("base64", "utf-8"), ("quoted-printable", "iso-8859-1"), ("8bit", "utf-8"), ("base64", "cp1252"), ("base64", "utf-16")):
        text = "Grüße aus Köln, déjà vu — 12 words = fun.\n" * 3
        if charset == "iso-8859-1":
            text = text.replace("—", "-")
        m = EmailMessage(policy=email.policy.SMTP)
        m["Subject"] = "x"
        if encoding == "8bit":
            source = raw(["Subject: x", "Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: 8bit"], text)
        elif encoding == "base64":
            source = raw(["Subject: x", f"Content-Type: text/plain;\n charset=\"{charset}\"", "Content-Transfer-Encoding: BASE64"], base64.encodebytes(text.encode(charset)).decode())
        else:
            m.set_content(text, charset=charset, cte=encoding)
            source = m.as_string()
        assert mail.seen_text(source).split() == text.split()


def test_multipart_attachments_and_messages():
    inner = "Subject: y\nContent-Type: text/plain\n\ninner words"
    body = "preamble\n--B\nContent-Type: text/plain\n\nfirst\n--B\nContent-Type: text/csv; name=\"a.csv\"\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment\n\n"
    body += base64.b64encode(b"csv,data").decode() + "\n--B\nContent-Type: message/rfc822\n\n" + inner + "\n--B\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\niVBORw0KGgo=\n--B--\nepilogue"
    source = raw(["From: a@b", 'Content-Type: multipart/mixed; boundary="B"'], body)
    assert mail.seen_text(source).split() == ["first", "csv,data", "inner", "words"]
    assert mail.own_paragraphs(source) == ["first"]


def test_mailbox_lines_don_t_end_the_headers():
    source = "Received: by x\nFrom a@b Mon Jan  4 00:02:25 2016\nSubject: s\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"hidden words").decode()
    assert mail.seen_text(source).strip() == "hidden words"


def test_html():
    source = raw(["Content-Type: text/html"], "<html><head><style>p {x}</style></head><body><p>one t<b>w</b>o&nbsp;three<br>four &amp; &eacute;</p><blockquote><p>quoted</p></blockquote><p>five</p></body></html>")
    assert mail.seen_text(source).split() == ["one", "two", "three", "four", "&", "é", "quoted", "five"]
    assert mail.own_paragraphs(source) == ["one two three four & é", "five"]


def test_own_text_of_replies():
    body = "Own one.\n\nOn Mon, 4 Jan 2016, A B wrote:\n\n> quoted\n> more\n\nOwn two,\nstill two.\n\n--\nName\nTel. 5\n\n-----Original Message-----\nFrom: x\n\nforwarded"
    assert mail.own_paragraphs(raw(["Subject: s"], body)) == ["Own one.", "Own two, still two."]


def test_damaged_texts_have_defined_results():
    assert mail.seen_text(None) == mail.seen_text("") == mail.seen_text(" \n ") == ""
    assert mail.own_paragraphs(None) == []
    assert mail.seen_text("just words\nno headers") == "just words\nno headers"
    cut = raw(['Content-Type: multipart/mixed; boundary="B"'], "--B\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\nd29yZHMgY3V0I")
    assert mail.seen_text(cut).startswith("words cut")
    assert "ok" in mail.seen_text(raw(["Content-Type: text/plain; charset=nonsense", "Content-Transfer-Encoding: quoted-printable"], "ok =C3=A9 =ZZ"))
    deep = "x"
    for i in range(60):
        deep = f'Content-Type: multipart/mixed; boundary="{i}"\n\n--{i}\n{deep}\n--{i}--'
    mail.seen_text(deep)
    assert len(mail.seen_text("a " * 2_000_000)) == 4_000_000


def test_mojibake_is_repaired():
    assert mail.repaired("BrÃ¼he Ã© naÃ¯ve") == "Brühe é naïve" and mail.repaired("Ãx") == "Ãx"


def test_messages_nested_at_any_depth():
    """Forwarded messages and parts far beyond any stack; the innermost text is read."""
    from jsonloom.llm.mail import parts, seen_text

    text = "Subject: innermost\n\nthe text inside"
    for _ in range(1500):
        text = "Subject: x\nContent-Type: message/rfc822\n\n" + text
    assert "the text inside" in seen_text(text) and [p.attached for p in parts(text)] == [True]
    body = "Content-Type: text/plain\n\ndeep part"
    for i in range(400):
        body = f'Content-Type: multipart/mixed; boundary="b{i}x"\n\n--b{i}x\n{body}\n--b{i}x--'
    assert seen_text("Subject: y\n" + body).strip() == "deep part"
