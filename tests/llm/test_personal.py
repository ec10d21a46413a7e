from __future__ import annotations

import hashlib
import random
import re
import time

from texts import SMALL, documents

from ledgerlane.llm import personal
from ledgerlane.llm.personal import Settings, digest, masked, personal_data
from ledgerlane.llm.tables import read, scratch

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def right(kind: str, hit: str) -> bool:
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": True, "ip": all(int(p) <= 255 for p in hit.split(".")) if kind == "ip" else False,
        "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
    }[kind]


def brute(text: str | None) -> list[str]:
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p in PATTERNS.items()
            for m in re.finditer(p, text or "") if right(kind, m[0])]


def check(spark, docs):
    got = digest(personal_data(docs, Settings(), scratch(spark, "t"))).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        own = r.spans.split(",") if r.spans else []
        assert own[:len(want)] == want and all(s.startswith("found:") for s in own[len(want):])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(s.startswith(k + ":") for s in want) for k in personal.KINDS]


def test_whole_small_table(spark):
    check(spark, read(spark, SMALL, "documents"))


def test_hard_texts(spark):
    texts = [
        None, "", "a@b.c_x@y.z", "a@b.c.d..e@f.g", "@@a@b", "x a.b+c%d@e-f.g- h", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.2.3.4",
        "1.2.3 1.2.3.256 1.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4116106959541135 5", "+1 (988) 555-2485.",
        "+1 234 +49 (0) 30 1234567 ++12345678", "+1((((((((((", "🙂🙂 a@b.cd 日本 10.0.0.1 é +12 345 678 90", "0" * 30_000, "1-" * 20_000,
        "a" * 50_000 + "@", "a." * 20_000 + "@b." + "c." * 20_000 + "d", "1." * 9_001 + "1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "٣٤٥ 4111111111111111١",
        "a@b.c" * 3000, "\n+12345678\n90", "-@-.-", "a@b.c@d.e",
    ]
    check(spark, documents(spark, list(enumerate(texts)), extra="row tokens found email start"))


def test_random_texts(spark):
    rng = random.Random(8)
    parts = ["1", "2", "99", ".", "@", "a", "-", " ", "+", "(", ")", "é", "🙂", "4111111111111111", "\n", "_", "%", "b.co"]
    check(spark, documents(spark, [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(800)]))


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"write to mail m{i}@x{i}.example or call") for i in range(40)]
    rows += [(100 + i, f"my number 10.0.{i}.7 is") for i in range(40)]
    rows += [(200, "my number 10.0.300.9 is"), (201, "some value 10.0.300.9 is"), (202, "my number one")]
    got = {r.doc_id: r for r in digest(personal_data(documents(spark, rows), Settings(), scratch(spark, "t"))).collect()}
    assert got[200].spans == "found:10:20" and got[200].n_ip == 0
    assert got[201].spans == "" and got[202].spans == "" and got[100].spans == "ip:10:18"


def test_masking_and_odd_rows(spark):
    rows = [(1, "é🙂 a@b.cd, +1 (988) 555-2485 end", "en", "s", 9), (2, None), (3, "clean"), (None, "10.0.0.1"), (1, "x a@b.cd")]
    docs = documents(spark, rows, extra="tokens marks row")
    got = {(r.doc_id, r.text, r.n_chars) for r in masked(docs, Settings(), scratch(spark, "t")).collect()}
    assert got == {(1, "é🙂 [email], [phone] end", 23), (2, None, None), (3, "clean", None), (None, "[ip]", 4), (1, "x [email]", 9)}
    assert masked(docs.limit(0), Settings(), scratch(spark, "t")).count() == 0
    plan = digest(personal_data(docs, Settings(), scratch(spark, "t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_identifiers_are_found_over_several_hops(spark):
    """Seeds teach one word, what follows that word teaches the next; addresses without a digit are seeds too."""
    rows = [(i, f"mail {'abcdefghij'[i % 10]}{'klmnop'[i // 10]}@x.example now") for i in range(40)]
    rows += [(100 + i, f"address 10.0.{i}.7 is") for i in range(250)]
    rows += [(400 + i, f"address 10.0.{300 + i}.9 is") for i in range(22)]  # no seeds, known by their word
    rows += [(500 + i, f"backup 10.0.{300 + i}.9 is") for i in range(22)]  # that word now has known tokens only
    rows += [(600, "backup 10.0.999.9 is"), (601, "pages 10.0.999.8 is"), (602, "mail 12@y now")]
    got = {r.doc_id: r.spans for r in digest(personal_data(documents(spark, rows), Settings(), scratch(spark, "t"))).collect()}
    assert all(got[400 + i] == "found:8:18" and got[500 + i] == "found:7:17" for i in range(22))
    assert got[600] == "found:7:17" and got[601] == ""


def test_a_hundred_thousand_tokens_in_a_text(spark):
    text = " ".join(str(10 ** 5 + i) for i in range(100_000)) + " a@b.cd"
    mails = "a@b.cd, " * 20_000
    docs = documents(spark, [(1, text), (2, mails)])
    began = time.time()
    got = {r.doc_id: r for r in digest(personal_data(docs, Settings(), scratch(spark, "t"))).collect()}
    assert got[1].spans.endswith(f"email:{len(text) - 6}:{len(text)}") and got[2].n_email == 20_000
    assert {r.text[:9] for r in masked(docs.where("doc_id = 2"), Settings(), scratch(spark, "t")).collect()} == {"[email], "}
    assert time.time() - began < 90


def test_rows_without_tokens_are_told_from_none(spark):
    """Marking is right for a row without tokens, which the optimizer may not have left out yet."""
    kind = "array<struct<start:bigint,end:bigint,before:string,shape:string,token:string>>"
    rows = spark.sql(f"SELECT CAST(array() AS {kind}) AS t, CAST(array() AS array<struct<start:bigint,end:bigint>>) AS s")
    assert rows.select(personal._marked("t", "s").alias("m")).first().m == []
