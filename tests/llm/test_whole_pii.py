"""Account numbers are found whatever follows them."""

from plumbline.llm import pii

GB, DE = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
#: Text, and the account numbers in it.
ACCOUNTS = [
    ("IBAN GB82WEST12345698765432 Please pay", ["GB82WEST12345698765432"]), (f"{GB} 2024", [GB]), (f"to {GB} A", [GB]), (f"{DE} EUR 1 200", [DE]),
    (f"{GB} {DE}", [GB, DE]), (f"{DE} {DE} {GB} AB12 X", [DE, DE, GB]), ("NO93 8601 1117 947 NOK", ["NO93 8601 1117 947"]), ("\U0001f600 MT84MALT011000012345MTLCAST001S IBAN", ["MT84MALT011000012345MTLCAST001S"]),
    (f"RF18 5390 0754 7034 {GB}", ["RF18 5390 0754 7034", GB]), (f"AB12 {GB} Now", [GB]), (f"{GB}a", []), (f"{GB}7", []), (f"x{GB}", []), (f"({GB})\n{DE}.", [GB, DE]), ("GB82 WEST 1234 5698 7654 33 Please", []),
    # a country without a known length: any end of a word, the last that passes
    ("ZZ35 1234 5678 9012 345 Please", None), ("", []), (None, []),
]


def valid(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_accounts_before_capitals_and_numbers(spark):
    base = "1234 5678 9012 345"
    check = next(f"{k:02}" for k in range(2, 99) if valid(f"ZZ{k:02} {base}"))
    texts = [(t.replace("ZZ35", f"ZZ{check}") if t else t, [f"ZZ{check} {base}"] if want is None else want) for t, want in ACCOUNTS]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.pii_iban for r in pii.find_pii(df).collect()}
    for i, (t, want) in enumerate(texts):
        assert [s.value for s in found[i]] == want, t
        assert all(t[s.start : s.end] == s.value and valid(s.value) for s in found[i])


def test_accounts_that_overlap(spark):
    """Of candidates one inside the other the first stays; many candidates in one text are no trouble."""
    inner = next(f"GB{k:02} {m} 1234 5698 7654 32" for m in ("DE89",) for k in range(2, 99) if valid(f"GB{k:02} {m} 1234 5698 7654 32"))
    df = spark.createDataFrame([(0, f"{inner} X"), (1, f"{GB} Pay " * 1_000), (2, "AB12 " * 5_000), (3, "A" * 50_000)], "doc_id long, text string")
    found = {r.doc_id: r.pii_iban for r in pii.find_pii(df).collect()}
    assert [s.value for s in found[0]] == [inner] and [s.start for s in found[1]] == [32 * k for k in range(1_000)]
    assert all(a.end <= b.start for a, b in zip(found[2], found[2][1:])) and not found[3]
