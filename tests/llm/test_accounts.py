"""Account numbers among ordinary words."""

from letterloom.llm import pii


def test_accounts_are_found_whatever_follows(spark):
    plain, spaced, british = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    texts = [(f"IBAN: {plain} BIC COBADEFFXXX", [plain]), (f"{spaced} Please pay", [spaced]),
             (f"pay {spaced} 2024", [spaced]), (f"{plain} {british}", [plain, british]),
             (f"REF AB12 {spaced} A", [spaced]), (f"FR76 {spaced} 1", [spaced]),
             (f"é😀 {british}. {spaced}, X", [british, spaced]),
             ("NO93 8601 1117 947 OK MT84MALT011000012345MTLCAST001S 7", ["NO93 8601 1117 947",
              "MT84MALT011000012345MTLCAST001S"]),
             (f"{plain}12", []), (f"X{plain}", []), (f"{plain[:-1]}1 BIC", []), (None, []), ("", [])]
    rows = pii.find_pii(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)],
                                              "doc_id long, text string")).collect()
    for r in rows:
        got = [r.text[s.start:s.end] for s in r.pii if s.kind == "iban"]
        assert got == texts[r.doc_id][1], r.text


def test_words_around_an_account_raise_its_score(spark):
    texts = ["x " * 40 + "my bank DE89370400440532013000 GB82WEST12345698765432",
             "DE89370400440532013000 " + "x " * 40 + "bank"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [[round(s.score, 2) for s in r.pii] for r in pii.find_pii(rows).collect()] \
        == [[1.0, 0.7], [0.7]]
