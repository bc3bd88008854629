import pytest

from kindred.functions import text as t

# raw name, core; worked out by hand from the rules
NAMES = [
    ("Copper Hill Estates Pvt Ltd", "copper hill estates"), ("Copper Hi1l Estates Pvt Ltd", "copper hiil estates"), ("Grand Inland Builders", "grand inland builders"),
    ("Bright Universal Private Limited", "bright universal"), ("Novadyne Company", "novadyne"), ("K+ Overseas LLC", "k overseas"), ("Shree Cotton Private Limited", "cotton"),
    ("Inc  Ltd", "inc ltd"), ("Shri Lotus Ínfra Private Límited", "lotus infra"), ("blueriver.com", "blueriver"), ("Northern Star - 9876543210", "northern star"),
    ("Sunr1se Exports Private Limited", "sunrise exports"), ("Nagpur Nagpur SOLAR Private Limited", "nagpur solar"), ("M/s Ruby Traders Private", "ruby traders"),
    ("Rivet +-[Co]", "rivet"), ("zenith pvt. co", "zenithpvt"), ("L L C Harbour & Sons", "harbour sons"), ("The Ltd And Corp", "the ltd corp"), ("4mber 9est 2021 Mart", "amber 9est mart"),
    ("O’Neil–Smith", "o neil smith"), ("Acme—Beta", "acme beta"), ("Москва Трейд", "moskva treid"), ("Καλημέρα Άγορα", "kalemera agora"), ("Café “Zürich” №x", "cafe zurich nox"),
    ("서울 무역", "seoul muyeog"), ("とうきょう", "toukiyou"), ("Straße Øst™ ½", "strasse ost tm 1 2"), ("", ""), (None, ""), ("क्रिएटिव ग्लोबल प्राइवेट लिमिटेड", None),
]
ADDRESSES = [
    ("Ganeshpur, Mill Road, Sonari Near Victoria Science Training College, Kolkata, Howrah North, West Bengal", "college ganeshpur howrah kolkata mill n rd science sonari training victoria", ""),
    ("88 Fenwick Road, Clarksburg, WV", "clarksburg fenwick rd", "88"),
    ("P No 212 To 219, 7-301/12/98, Shantinagar, Begumpet, Medchal, Hyderabad, Telangana", "begumpet hyderabad medchal shantinagar to", "12 212 219 301 7 98"),
    ("420 9th Street, MN, Grand Marais", "grand marais st", "420 9"), ("NINTH ST, GRAND MARAIS, MN", "grand marais ninth st", ""),
    ("P No.14, Block No.3, Rani Nagar, Old Station Road, Jaipur, Rajasthan", "block jaipur ngr old rani rd station", "14 3"),
    ("F-2, Orchid Apts, No. 57, 8Th Cross Indiranagar, Bangalore, Karnataka", "apts bangalore cross indiranagar orchid", "2 57 8"),
    ("31 Barton Drive, New Haven, KY", "barton dr haven new", "31"), ("2222Surya Building M G Marg C P, New Delhi, Delhi", "building new rd surya", "2222"),
    ("C4/610, Lake City, Plot No. Gh-09, Sector-62, Noida, Gautam Nagar, Uttar Pradesh", "gautam gh lake ngr noida sec", "4 610 62 9"),
    ("Sagar, Third Floor, 6 - Tilak Nagar, Ring Chowk, Rajkot, Gujarat", "3rd chowk ngr rajkot ring sagar tilak", "6"),
    ("Plot ##17/3/2/B6 Lakeside Road, Lakeside Ranpur, Ranpur, MH", "lakeside ranpur rd", "17 2 3 6"), ("OH, Dayton, 4410 Maple Avenue", "ave dayton maple", "4410"),
    ("9-DD, IIIRD ADDITIONAL MARKET, HISAR, हरियाणा", "additional dd hisar iiird market", "9"), ("Court, Ct, Second, 2nd", "2nd ct", "2"), ("00231 000", "", "0 231"), (None, "", ""),
    ("12 rue de l’Église – Lyon", "eglise lyon rue", "12"),
]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMES], "business_name string")
    got = {r["business_name"]: r for r in t.normalize_names(df, "business_name").collect()}
    for raw, core in NAMES:
        if core is not None:
            assert got[raw]["n_core"] == core and got[raw]["n_compact"] == core.replace(" ", "")
    assert got["blueriver.com"]["n_domain"] and got["zenith pvt. co"]["n_domain"] and not got["Inc  Ltd"]["n_domain"]
    indic = got["क्रिएटिव ग्लोबल प्राइवेट लिमिटेड"]
    assert indic["n_translit"] and indic["n_tokens"] == ["krietti" + "v", "globl"]


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in ADDRESSES], "a string")
    got = {r["a"]: r for r in t.normalize_addresses(df, "a").collect()}
    for raw, words, numbers in ADDRESSES:
        assert (got[raw]["a_text"], got[raw]["a_nums"], got[raw]["a_empty"]) == (words, numbers, not words and not numbers)


@pytest.mark.parametrize(("word", "key"), [("limited", "lmtd"), ("limittedd", "lmtd"), ("private", "prvt"), ("praaivett", "prvt"), ("phone", "fn"), ("whizz", "vj"), ("aardvark", "ardvrk"), ("", "")])
def test_skeleton(spark, word, key):
    assert spark.createDataFrame([(word,)], "w string").select(t.skeleton(t.F.col("w"))).first()[0] == key


def test_leet_and_dictionary(spark):
    df = spark.createDataFrame([("h0rizon",), ("5mart",), ("8est",), ("123",)], "w string")
    assert [r[0] for r in df.select(t.fix_leet(t.F.col("w"))).collect()] == ["horizon", "smart", "8est", "123"]
    known = t.F.create_map(t.F.lit("जैन"), t.F.lit("jain"))
    names = spark.createDataFrame([("जैन (टेक)",), ("Jain",)], "business_name string")
    assert [r[0] for r in names.select(t.translate_indic(t.F.col("business_name"), known)).collect()] == ["jain (टेक)", "Jain"]
    assert t.normalize_names(names, "business_name", known).first()["n_tokens"][0] == "jain"


def test_indic_spelling_follows_the_letters_names():
    spelt = t.indic_letters()
    assert "".join(spelt.get(c, "") for c in "క్రియేటివ్ గ్లోబల్".replace(" ", "")) == "kriyeettivgloobl"
