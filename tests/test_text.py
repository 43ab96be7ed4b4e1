from pyspark.sql import functions as F

from deltaweave.functions import text


def one(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_price_forms(spark):
    assert one(spark, text.price, ["14.90", "1e2", " 0 ", "0.0001"]) == [14.9, 100.0, 0.0, 0.0001]
    assert one(spark, text.price, ["10000000000", "9999999999.99999", "0.000001", "-1", "1d", "NaN", "", None, "1,5"]) == [None] * 9


def test_stock_forms(spark):
    assert one(spark, text.stock, ["08", "0001", "00", "+00012", "-0004", " 7 ", "2147483647"]) == [8, 1, 0, 12, 0, 7, 2147483647]
    assert one(spark, text.stock, ["2147483648", "1.0", "8x", "--1", "+-1", "", None, "99999999999999999999999999999999999999999"]) == [None] * 8
    assert one(spark, text.stock_was_negative, ["-0004", "-0", "4"]) == [True, False, False]


def test_bounds_count_characters(spark):
    f = lambda c: text.bounded(c, text.MAX_NAME)
    assert one(spark, f, ["é" * 128, "é" * 129, " ", "a<b", "a{b", "it's & = ; / ok"]) == [True, False, False, False, False, True]


def test_slug_falls_back_to_a_digest(spark):
    a, b, c = one(spark, text.slug, ["  Größe / XL ", "***", "x" * 200])
    assert a == "größe-xl" and b.startswith("hash-") and len(b) == 37 and len(c) == 153 and c.startswith("x" * 120 + "-")


def test_paths_and_segments(spark):
    assert one(spark, text.path, ["/A// B /\tC/", "", "///"]) == ["A > B > C", "", ""]
    assert one(spark, text.segment, [" @@Shoes--&  Bags "]) == ["shoes bags"]
    assert one(spark, text.path_key, ["@A > B_c >  > D"]) == ["a > b c > d"]


def test_urls(spark):
    good = ["http://a.example/x", "  HTTPS://a.example  ", "https://a.example:8080/?q"]
    bad = ["ftp://a.example/", "https://u:p@a.example/", "https:///x", "", "x", "http://a.example/" + "y" * 17000]
    assert one(spark, text.url_is_sound, good + bad) == [True] * 3 + [False] * 6


def test_redaction(spark):
    assert one(spark, text.redact, ["get http://me:pw@h/x\n password : abc, AccessKey=zz;"]) == ["get http://***:***@h/x password=***, AccessKey=***;"]
    logins = ["sftp://me:p@w@h:22/a@b", "jdbc:db://u:p@h1:3306/x then ftp://v:q@h2?c=d", "http://h:80/x:y@z", "http://me@h/", "no address a:b@c", None, ""]
    assert one(spark, text.redact, logins) == ["sftp://***:***@h:22/a@b", "jdbc:db://***:***@h1:3306/x then ftp://***:***@h2?c=d", "http://h:80/x:y@z", "http://me@h/", "no address a:b@c", None, ""]
    values = ["a=1;Password=x=y:z,secret=k", "authorization: Bearer abc", "myACCESSKEY = v; rest", "the password is long", "password=", "password=http://h/?a=b rest", "password: authorization=x end"]
    assert one(spark, text.redact, values) == ["a=1;Password=***,secret=k", "authorization=*** abc", "myACCESSKEY=***; rest", "the password is long", "password=***", "password=*** rest", "password=*** end"]
    assert one(spark, text.redact, ["x" * 5000]) == ["x" * 1200]


def test_sanitiser_unwraps_and_keeps_text():
    html = '<p class="a" onclick="x()">Hi <script>var a;</script><a href="u"><b>you</b></a><!-- c --><iframe>z</iframe> & <br/></p>'
    out = text.sanitise_one(html)
    assert out.startswith('<p class="a">Hi ') and "<b>you</b>" in out and "onclick" not in out and "<a" not in out and "iframe" not in out and "<!--" not in out and "&amp;" in out
    assert text.sanitise_one(None) == "" and text.sanitise_one("<b>open") == "<b>open</b>"
