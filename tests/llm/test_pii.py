import hashlib
import random
import re
import time

from staylens.llm import pii

BASE = {  # the rules as they are stated
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
            "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    spans = []
    for k, (kind, p) in enumerate(BASE.items()):
        spans += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return sorted(spans)


IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"


def account(m):
    plain = m.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def brute_all(text):
    return sorted(brute(text) + [(m.start(), 4, m.end(), "iban") for m in re.finditer(IBAN, text or "") if account(m[0])])


def brute_mask(text):
    runs = []
    for a, _, b, kind in brute_all(text):
        if runs and runs[-1][1] > a:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b, kind])
    for a, b, kind in reversed(runs):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def check(spark, rows):
    got = {}
    for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], r)
    for i, t in rows:
        want = brute(t)
        shown = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[3] == k for s in want) for k in BASE], (t, want)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_all(t))
    return got


def test_against_stated_rules(spark):
    rng = random.Random(5)
    bits = ["a", "B7", "@", ".", "-", "+", " ", "  ", "1", "255", "4111 1111 1111 1111", "0", "(", ")", "é", "\U0001f600", "\n", "%", "x@y.zz",
            "+49 30 1234-5678", "1.2.3.4", "256.1.1.1", "4242-4242-4242-4242", "a@b.c%d@e.f", "00000001.2.3.4"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "9" * 30000), (1003, "a" * 30000), (1004, "a." * 20000 + "@"), (1005, "+1" + " " * 20000),
             (1006, "x@y.zz " * 1500), (1007, "1." * 9000), (1008, "é@a.b 1.2.3.4"), (1008, "é@a.b 1.2.3.4")]
    check(spark, rows)


def test_account_numbers_context_and_masks(spark):
    good, bad = "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32"
    rows = [(1, f"my bank account {good}."), (2, f"see {bad}."), (3, "DE89370400440532013000"), (4, "order DE89370400440532013000")]
    got = check(spark, rows)
    assert "iban:16:43" in got[1]["spans"] and "iban" not in got[2]["spans"] and "iban:0:22" in got[3]["spans"]
    scores = {i: dict(zip((s.split(":")[0] for s in r["spans"].split(",")), r["scores"])) for i, r in got.items()}
    assert scores[1]["iban"] > scores[3]["iban"] > scores[4]["iban"]
    frame = spark.createDataFrame([(1, "mail é@a.b bob@x.org, call +49 30 1234-5678!", "p"), (2, None, "q"), (3, "plain", None)],
                                  "doc_id long, text string, pii string")
    rows = {r["doc_id"]: r for r in pii.mask_pii(frame).collect()}
    assert rows[1]["text"] == "mail é@a.b [EMAIL], call [PHONE]!" and rows[1]["pii"] == "p"
    assert rows[2]["text"] is None and rows[3]["text"] == "plain" and list(rows[3].asDict()) == ["doc_id", "text", "pii"]
    assert pii.digest(frame.limit(0)).count() == 0


def test_masks_and_accounts_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB83 WEST 1234 5698 7654 32", "ES91 2100 0418 4502 0005 1332", "+49 30 1234-5678",
            "4111 1111 1111 1111", "1.2.3.4", "a@1.2.3.4", "+1.2.3.4.5.6.7.8.9", "x@y.zz", " ", " ", "\n", "é", "\U0001f600", "word" * 70, "7", "."]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 256 + " 1.2.3.4"), (1003, "x" * 255 + " 1.2.3.4 " + "\U0001f600" * 600), (1004, "1.2.3.4"),
             (1005, "é x@y.zz\n" * 3000), (1006, "1.2.3.4 x@y.zz,+49 30 1234-5678;" * 700)]
    check(spark, rows)
    frame = spark.createDataFrame([(i, t, i, t) for i, t in rows + rows[-3:]], "doc_id long, text string, pii_runs long, pii_ string")
    got = pii.mask_pii(frame).collect()
    assert len(got) == len(rows) + 3 and list(got[0].asDict()) == frame.columns
    for r in got:
        assert r["text"] == (None if r["pii_"] is None else brute_mask(r["pii_"])), r["doc_id"]
        assert r["pii_runs"] == r["doc_id"]


def test_time_in_proportion_to_the_matches(spark):
    def seconds(n):
        frame = spark.createDataFrame([(1, "é x@y.zz 1.2.3.4, " * (n // 2))], "doc_id long, text string")
        began = time.perf_counter()
        masked, found = pii.mask_pii(frame).collect()[0]["text"], pii.digest(frame).collect()[0]
        assert masked == "é [EMAIL] [IP], " * (n // 2) and found["n_email"] == found["n_ip"] == n // 2
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(64000) < 8 * min(seconds(16000), seconds(16000))      # 16 times where it is quadratic


def test_no_python_on_the_main_path(spark):
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for out in (pii.digest(frame), pii.mask_pii(frame)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
