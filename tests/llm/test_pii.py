import random
import re

import pytest
from pyspark.sql import functions as F

from bucketwise.llm import pii


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_pii(df, "k").orderBy("doc_id").collect()]


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_formats_and_coreference(spark):
    a, b, c, d, e = replaced(
        spark,
        [
            "Mail A.B@x.org or a.b@X.org, call +1 (409) 555-8387 or 409-555-8387.",
            'pay 4111 1111 1111 1111 or 4111111111111111, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" from 1.2.3.4',
            "Mr. John Smith met Frau Müller and Mr. JOHN; г-жа Анна Иванова",
            None,
            "no 12 entities 3.14 here: a@b, 1.2.3, 256.1.1.1, 12:30",
        ],
    )
    m = re.fullmatch(r"Mail (\S+) or (\S+), call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})\.", a)
    assert m and m[1] == m[2] != "a.b@x.org" and m.group(3, 4, 5) == m.group(6, 7, 8) != ("409", "555", "8387")
    m = re.fullmatch(r'pay ([\d ]{19}) or (\d{16}), token = "([0-9a-f]{40})" from (\d+\.\d+\.\d+\.\d+)', b)
    assert m and m[1].replace(" ", "") == m[2] != "4111111111111111" and m[2][0] == "4" and luhn(m[2])
    assert m[4] != "1.2.3.4" and all(1 <= int(x) <= 254 for x in m[4].split("."))
    m = re.fullmatch(r"Mr\. (\w+) (\w+son) met Frau (\w+son) and Mr\. JOHN; г-жа (\w+) (\w+ова)", c)
    assert m and m[1] in pii.GIVEN["m", "latin"] and m[4] in pii.GIVEN["f", "cyrillic"] and "Smith" not in c
    assert d is None and e == "no 12 entities 3.14 here: a@b, 1.2.3, 256.1.1.1, 12:30"


def test_collisions_are_resolved(spark, monkeypatch):
    # a space of ten addresses, of which five are themselves entities
    def small(kind, norm, attempt, key):
        n = F.pmod(F.xxhash64(norm, attempt), F.lit(40))
        return F.concat(F.lit("1.1.1."), n.cast("string"))

    monkeypatch.setattr(pii, "surrogate", small)
    norms = [f"1.1.1.{i}" for i in range(10)] + [f"9.9.9.{i}" for i in range(12)]
    out = pii.surrogates(spark.createDataFrame([("ip", n) for n in norms], "kind string, norm string"), "k").collect()
    new = [r.new for r in out]
    assert len(out) == 22 and len(set(new)) == 22 and not set(new) & set(norms)


def test_test_data(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    email, phone, ip = r"[\w.]+@[\w.]+\w", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b\d+\.\d+\.\d+\.\d+\b"
    card, secret = r"(?<!\d)\d{16}(?!\d)", r"(?:token = \"|password=)\w+"
    seen = {}
    for r in pii.op1_pii_surrogates(spark, sf_dir).collect():
        old = docs[r.doc_id]
        kinds = (email, phone, ip, card, secret)
        real = lambda x: luhn(x) and (x[0] in "3456" or "22" <= x[:2] <= "27")
        of = lambda p, text: [x for x in re.findall(p, text) if p != card or real(x)]
        found = [x for p in kinds for x in of(p, old)]
        assert [x for x in re.findall(card, old) if not real(x)] == [x for x in re.findall(card, r.text) if not real(x)]
        assert (r.n_replaced > 0) == bool(found) and (found or r.text == old)
        for p in kinds:
            before, after = of(p, old), of(p, r.text)
            assert len(before) == len(after) and not set(before) & set(after)
            for x, y in zip(before, after):
                assert seen.setdefault(x, y) == y
    assert len(seen) > 10 and len(set(seen.values())) == len(seen)


def test_odd_rows(spark, odd, empty):
    marked = odd.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("to q@r.org "), "text")).otherwise(F.col("text")))
    out = pii.replace_pii(marked, "k")
    assert out.columns == [*odd.columns, "pii_found"] and out.count() == odd.count()
    assert out.where(F.col("text").contains("q@r.org")).count() == 0
    assert out.where("text is null").count() == odd.where("text is null").count()
    assert pii.replace_pii(empty, "k").count() == 0


def test_no_python_on_the_executors(spark, sf_dir):
    plan = pii.op1_pii_surrogates(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_small_spaces_are_widened(spark, monkeypatch):
    # more names than surrogates of three syllables, all one-letter addresses of a domain, a secret that cannot change
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["bar", "bel", "cor"])
    rows = [("family", f"latin:{a}{b}") for a in "abcdefgh" for b in "mnopqrst"] + [("given", f"m:latin:{a}{b}") for a in "abcdef" for b in "mnopqrst"]
    rows += [("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"] + [("secret", "--------")]
    out = pii.surrogates(spark.createDataFrame(rows, "kind string, norm string"), "k").collect()
    new = {(r.kind, r.new) for r in out}
    assert len(out) == len(rows) == len(new) and not new & set(rows)
    shapes = {"family": r"latin:(?:bar|bel|cor){3,}son", "given": r"m:latin:[a-z]+", "email": r"[a-z]+@m[0-9a-f]{6}\.example\.net", "secret": "-{8}[a-z]+"}
    assert all(re.fullmatch(shapes[r.kind], r.new) for r in out)
    assert replaced(spark, ['token = "--------"'])[0] != 'token = "--------"'


def test_a_full_space_is_permuted(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ATTEMPTS", 2)
    monkeypatch.setattr(pii, "surrogate", lambda kind, norm, attempt, key: F.when(norm == "x0", "free").otherwise("x1"))
    rows = [("ssn", f"x{i}") for i in range(30)]
    out = {r.norm: r.new for r in pii.surrogates(spark.createDataFrame(rows, "kind string, norm string"), "k").collect()}
    assert len(out) == 30 == len(set(out.values())) and out["x0"] == "free" and all(k != v for k, v in out.items())


def test_names_share_what_they_have_in_common(spark):
    a, b, c, d, e, f = replaced(
        spark,
        [
            "Dr John Smith saw Mr John Smith and Mr Smith.",
            "Mrs Smith and Mr. John Brown; Prof Maria Smith, Mrs Maria Lee.",
            "г-н Иванов и г-жа Иванова, г-жа Мария Иванова",
            "Mr Παπαδόπουλος and Frau Άννα Παπαδόπουλος",
            "Mr 田中 and Mrs Հակոբ stay; John Smith without a title too",
            "Dr Robin Smith",
        ],
    )
    m = re.fullmatch(r"Dr (\w+) (\w+) saw Mr (\w+) (\w+) and Mr (\w+)\.", a)
    given, family = m[1], m[2]
    assert (m[3], m[4], m[5]) == (given, family, family) and family != "Smith" and given in pii.GIVEN["m", "latin"]
    m = re.fullmatch(r"Mrs (\w+) and Mr\. (\w+) (\w+); Prof (\w+) (\w+), Mrs (\w+) (\w+)\.", b)
    assert m[1] == m[5] == family and m[2] == given and m[4] == m[6] in pii.GIVEN["f", "latin"] and len({m[3], m[7], family}) == 3
    m = re.fullmatch(r"г-н (\w+ов) и г-жа (\w+ова), г-жа (\w+) (\w+ова)", c)
    assert m[2] == m[4] == m[1] + "а" and m[1] != "Иванов" and m[3] in pii.GIVEN["f", "cyrillic"]
    m = re.fullmatch(r"Mr (\w+ίδης) and Frau (\w+) (\w+ίδης)", d)
    assert m[1] == m[3] and m[2] in pii.GIVEN["f", "greek"]
    assert e == "Mr 田中 and Mrs Հակոբ stay; John Smith without a title too"
    assert f.split()[1] in pii.GIVEN["u", "latin"] and f.split()[2] == family


def test_checked_numbers_and_networks(spark):
    def valid(iban):
        moved = (iban[4:] + iban[:4]).replace(" ", "")
        return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1

    (text,) = replaced(
        spark,
        [
            "DE89 3704 0044 0532 0130 00, GB29NWBK60161331926819; 123-45-6789 | 10.0.0.5 192.168.3.4 172.20.1.1 127.0.0.1 169.254.9.9 8.8.4.4 | "
            "+33 1 23 45 67 89, +44 20 7946 0958, +49 30 1234567, (409) 555-8387, +1 409 555 8387 | 4111 1111 1111 1112 7536784127813050"
        ],
    )
    numbers, nets, phones, card = text.split(" | ")
    a, b, ssn = re.fullmatch(r"(DE\d\d(?: \d{4}){4} \d\d), (GB\d\d[A-Z]{4}\d{14}); (\d{3}-\d\d-\d{4})", numbers).groups()
    assert valid(a) and valid(b) and a != "DE89 3704 0044 0532 0130 00" and ssn != "123-45-6789"
    ten, home, middle, own, link, public = nets.split()
    assert ten.startswith("10.") and home.startswith("192.168.") and own.startswith("127.") and link.startswith("169.254.")
    assert re.match(r"172\.(1[6-9]|2\d|3[01])\.", middle) and not set(nets.split()) & {"10.0.0.5", "192.168.3.4", "172.20.1.1", "127.0.0.1", "169.254.9.9", "8.8.4.4"}
    assert int(public.split(".")[0]) in pii._PUBLIC
    m = re.fullmatch(r"\+33 (\d \d\d \d\d \d\d \d\d), \+44 (\d\d \d{4} \d{4}), \+49 (\d\d \d{7}), \((\d{3})\) (\d{3})-(\d{4}), \+1 (\d{3}) (\d{3}) (\d{4})", phones)
    assert m and m[1] != "1 23 45 67 89" and m.group(4, 5, 6) == m.group(7, 8, 9) != ("409", "555", "8387")
    assert card == "4111 1111 1111 1112 7536784127813050"  # a wrong check digit, and no issuer's number


def test_no_entity_is_lost_beside_numbers(spark):
    leaks = {
        "in 2024 555-123-4567 now": ["555-123-4567"],
        "Tel: 555-123-4567 555-987-6543 end": ["555-123-4567", "555-987-6543"],
        "ids 123-45-6789 987-65-4321 end": ["123-45-6789", "987-65-4321"],
        "order 4417 123-45-6789 123456 x": ["123-45-6789"],
        "4111 1111 1111 1111 123": ["4111 1111 1111 1111"],
        "4111 1111 1111 1112 555-123-4567": ["555-123-4567"],
        "4111 1111 1111 1111 555.123.4567": ["4111 1111 1111 1111", "555.123.4567"],
        "2024 1234 5678 555.123.4567": ["555.123.4567"],
        "1234 5678 9012 3456@x.org": ["3456@x.org"],
        "+44 20 7946 0958 555-123-4567": ["7946 0958", "555-123-4567"],
        "AB12 3456 7890 1234 555-123-4567": ["555-123-4567"],
        "1 2 3 4 5 6 7 8 9 10 8.8.4.4": ["8.8.4.4"],
    }
    for text, (new, gone) in zip(leaks, zip(replaced(spark, list(leaks)), leaks.values())):
        assert not any(g in new for g in gone), (text, new)
        assert len(new) == len(text) or "8.8" in text or "@" in text


def test_entities_in_any_order_and_distance(spark):
    """Against a scanner that knows what it put where."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = rng.choice("3456") + digits(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice((number, " ".join(number[i : i + 4] for i in range(0, 16, 4)), "-".join(number[i : i + 4] for i in range(0, 16, 4))))

    makes = {
        "phone": lambda: rng.choice((f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+1 {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}")),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "card": card,
        "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "email": lambda: f"{digits(3)}.{rng.choice('abc')}{digits(2)}@x{digits(2)}.org",
    }
    texts, hidden = [], []
    for _ in range(400):
        parts, own = [], []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.3:
                parts.append(rng.choice(("2024", "7", "no.", digits(6), digits(2), "x")))
            else:
                own.append(makes[rng.choice(list(makes))]())
                parts.append(own[-1])
        texts.append("".join(p + rng.choice((" ", " ", ", ", "; ", "\n")) for p in parts))
        hidden.append(own)
    for text, new, own in zip(texts, replaced(spark, texts), hidden):
        assert not any(e in new for e in own), (text, new)


def test_a_key_is_needed_and_own_columns_are_refused(spark, odd):
    with pytest.raises(TypeError):
        pii.replace_pii(odd)
    with pytest.raises(ValueError, match="key"):
        pii.replace_pii(odd, "")
    with pytest.raises(ValueError, match="pii_found"):
        pii.replace_pii(odd.withColumn("pii_found", F.lit(1)), "k")
    (a,), (b,) = (r for r in (pii.replace_pii(spark.createDataFrame([("a@b.org",)], "text string"), k).select("text").first() for k in ("k", "l")))
    assert a != b
