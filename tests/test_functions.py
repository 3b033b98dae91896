"""Golden cases for the text, byline, date and URL rules."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from broadsheet.functions import authors, dates, html, page_fields, text, urls
from broadsheet.operators.page_parser import ROW, parse


def test_clean_text_removes_boilerplate_after_collapsing(values):
    cases = {
        "  a\n\tb\xa0c  ": "a b c",
        "Tin. Ảnh: TTXVN. Hết": "Tin.  Hết",
        "ẢNH: X. sau": "sau",
        "Mở đầu. BẢN QUYỀN THUỘC VỀ báo\nmọi dòng sau mất": "Mở đầu.",
        "A Video: clip dài. B Độc giả gửi thư. C": "A  B  C",
        "Chia sẻ bài viết qua email xong": "xong",
        "Hỏi: Hãy gửi câu hỏi về địa chỉ": "Hỏi:",
        None: "",
    }
    assert values(text.clean_text, list(cases)) == list(cases.values())


def test_author_validity(values):
    cases = {
        "Nguyễn Văn A": True, "A": False, "x" * 101: False, "1. Tin nóng": False, "Sao vậy?": False, "Hay!": False,
        "0912 345 678": False, "Lan 15/12": False, "Lan 4:22": False, "một hai ba bốn sáu tám chín": False,
        "một hai ba, bốn sáu tám chín": True, "Báo một hai ba bốn sáu tám": True, "Thứ Hai": False, "Mayer": False,
        "THÁNG Ba": False, "Ảnh: Lan": False, None: False,
    }
    assert values(authors.is_valid_author, list(cases)) == list(cases.values())


def test_house_names_and_invalid_bylines_are_demoted(values):
    cases = {"Ban Biên Tập": True, "Báo Dân trí": True, "Nguyễn A": False, "12/5": True, "": False, None: False}
    assert values(authors.demoted, list(cases)) == list(cases.values())


def test_candidate_cleaning(values):
    cases = {
        "Trần B • 15 phút": "Trần B", "Lê C - 0912 345 678": "Lê C", "Lê C\u00a0-\u00a00912\u00a0345\u00a0678": "Lê C", "Hotline: 0912.345.678 Lan": "Lan",
        "-Vũ E-": "Vũ E", "Lan +84 912345678": "Lan",
    }
    assert values(authors.clean_candidate, list(cases)) == list(cases.values())


def test_author_split(values):
    cases = {
        "Nguyễn A, Trần B": ["Nguyễn A", "Trần B"], "Lê C và Phạm D": ["Lê C"], "Hoàng E (TTXVN) - Vũ F": ["Hoàng E", "Vũ F"],
        "(TTXVN)": ["Unknown"], "A VÀ B": ["A"], '["Lan", ""]': ["Lan", "Unknown"],
    }
    assert values(authors.author_list, list(cases)) == list(cases.values())


def test_date_forms(values):
    cases = {
        "2026-04-06T19:33:00+07:00": "2026-04-06 19:33:00", "2026-04-06  9:05": "2026-04-06 09:05:00",
        "Thứ hai, 6/4/2026, 17:02 (GMT+7)": "2026-04-06 17:02:00", "14:29 06/02/2024": "2024-02-06 14:29:00",
        "Ngày 6-4-2024": "2024-04-06 00:00:00", "31/02/2024 10:00": None, "2024-04-06": None, "": None, None: None,
        "6/4/2024\xa0 5:30 PM": "2024-04-06 05:30:00",
    }
    assert values(lambda x: F.date_format(dates.parse_date(x), dates.DATE_TEXT), list(cases)) == list(cases.values())


def test_impossible_date_moves_on_to_the_next_place(values):
    page = '<meta name="pubdate" content="31/02/2024 10:00"><span class="date">05/03/2024</span>'
    got = values(lambda x: dates.render_date(page_fields.publish_date(F.lit("https://h/x"), x)), [page, "<p>no date</p>"], parse)
    assert got == ["2024-03-05 00:00:00", "Unknown"]


def test_date_key_and_seconds(values):
    assert [str(d) for d in values(dates.date_key, ["2024-01-05 08:30:00", "2024-1-5 8:3:0", "31/12/2023 10:00", "2024-02-30 00:00:00"])] \
        == ["2024-01-05", "2024-01-05", "None", "None"]
    assert values(dates.publish_seconds, ["2024-01-05", "Unknown", None, "2024-01-05 23:59:59"]) == [1704412800, 0, 0, 1704412800]


def test_domain_and_authority(values):
    assert values(urls.domain, ["https://a.b/c", "plain", "//h/x", "http://h:80/x"]) == ["a.b", "plain", "h", "h:80"]
    assert values(urls.authority, ["http://h:80/x?y", "https://a.b?q", "//c.d/e"]) == ["h:80", "a.b", "c.d"]


def test_resolve_links(spark):
    base = "https://h.com/a/b.html?x=1#f"
    cases = {
        "/c": "https://h.com/c", "c": "https://h.com/a/c", "../c": "https://h.com/c", "./c?q=1": "https://h.com/a/c?q=1",
        "//o.com/c": "https://o.com/c", "?p=2": "https://h.com/a/b.html?p=2", "http://o.com/../x": "http://o.com/../x",
        "": "https://h.com/a/b.html?x=1", "../../../c/": "https://h.com/c/", "c/..": "https://h.com/a/",
    }
    df = spark.createDataFrame([(i, base, h) for i, h in enumerate(cases)], "i int, page string, href string")
    got = [r[0] for r in df.orderBy("i").select(urls.resolve(df.page, df.href)).collect()]
    assert got == list(cases.values())


def test_link_kinds(spark):
    page = "https://h.com/"
    cases = {
        "https://h.com/a.html": "article", "https://h.com/a/b": "section", "https://h.com/a/b/c": None,
        "http://h.com/a": None, "https://h.com/x.amp?y": "article", "https://h.com": "section",
    }
    df = spark.createDataFrame([(i, page, u) for i, u in enumerate(cases)], "i int, page string, url string")
    assert [r[0] for r in df.orderBy("i").select(urls.link_kind(df.page, df.url)).collect()] == list(cases.values())


def test_point_ids_match_the_standard_library(spark):
    df = spark.range(200).select("id", (F.col("id") * 7 % 13).alias("c"))
    rows = df.select("id", "c", text.point_id(F.col("id"), F.col("c")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"article_{r['id']}_chunk_{r['c']}")) for r in rows)


def test_rounding_is_half_up(spark):
    row = spark.range(1).select(
        text.percent(F.lit(1), F.lit(3)).alias("a"), text.percent(F.lit(1), F.lit(0)).alias("b"),
        text.ratio(F.lit(7), F.lit(2), 2).alias("c"), text.percent(F.lit(2), F.lit(3)).alias("d"),
    ).first()
    assert tuple(row) == (33.3, 0.0, 3.5, 66.7)


def test_byline_places(values):
    pages = {
        '<a href="/tac-gia/lan">Lan Anh</a><span class="author">Khác</span>': "Lan Anh",
        '<div class="name"><a href="/x/tac-gia-1" title="Minh"> </a></div>': "Minh",
        '<span class="t3">Hoa</span>': "Hoa",
        '<div class="author-info big"><p class="name">Tú</p></div>': "Tú",
        '<div class="author-name"><a>Sơn</a></div>': "Sơn",
        '<p itemprop="author"><span itemprop="name">Vân</span></p>': "Vân",
        '<p style="text-align: right"><strong>Kiên</strong></p>': "Kiên",
        '<p class="t-a-r"><b>Phúc</b></p>': "Phúc",
        '<div class="font-medium relative">Hà</div>': "Hà",
        '<span class="author">15/12/2023</span><span class="tacgia">Đức &amp; Mai</span>': "Đức & Mai",
        '<div class="authors">Không</div>': None,
        '<span class="author">Unknown</span>': None,
    }
    assert values(page_fields.cascade, list(pages), parse) == list(pages.values())


def test_page_text_keeps_only_the_body(values):
    page = ("<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head&amp;er</h1><!-- x --><script>p</script>"
            "<p>One<br>two</p><p>a&nbsp;&lt;b&gt;</p></article><footer>f</footer></body></html>")
    assert values(html.page_text, [page], parse) == ["One two a <b>"]
    assert values(html.page_title, [page, "<title> T </title>"], parse) == ["Head&er", "T"]


def test_markup_as_pages_write_it(values):
    """Written by hand from the rules; none of these pages is built from the places' own definitions."""
    pages = {
        '<span class="author"><b>By</b> Tran Van B</span>': "Tran Van B",
        '<div class="author-info"><div><i>x</i></div><p><span class="name">Lan</span></p></div>': "Lan",
        "<span class=author>Minh Anh</span>": "Minh Anh",
        '<span class="author">L&ecirc; &#7878;</span>': "Lê Ệ",
        '<!-- <span class="author">Không</span> --><p>x</p>': None,
        '<div class="news-detail-project">\n<b>Hoa</b> <i>Mai</i></div>': "Hoa Mai",
        '<a rel="author">An</a><a rel="author">Bình</a>': "An Bình",
        '<a href="/tac-gia/1" title="Tú Anh"></a>': "Tú Anh",
        '<div class="post-author">Nga</div>': "Nga", '<p class="article-author">Nhi</p>': "Nhi", '<p class="detail-author">Oanh</p>': "Oanh",
        '<p class="tac-gia">Quý</p>': "Quý", '<p class="tacgia">Quân</p>': "Quân", '<b rel="author">Sa</b>': "Sa",
        '<div style="text-align: right"><p><strong>Thu</strong></p></div>': "Thu", '<p style="text-align:right"><strong>Thy</strong></p>': "Thy",
        '<p class="t-a-r"><strong>Uyên</strong></p>': "Uyên", '<div class="name"><a href="/tac-gia/v">Vy</a></div>': "Vy",
    }
    assert values(page_fields.cascade, list(pages), parse) == list(pages.values())


def test_every_place_of_a_date(values):
    pages = {
        '<meta property="article:published_time" content="2024-01-01T01:01:00">': "2024-01-01 01:01:00",
        '<time datetime="2024-01-02 02:02"></time>': "2024-01-02 02:02:00", "<time>03/01/2024 03:03</time>": "2024-01-03 03:03:00",
        '<meta content="2024-01-04 04:04" name="pubdate">': "2024-01-04 04:04:00",
        '<p class="publish-date">05/01/2024</p>': "2024-01-05 00:00:00", '<p class="bread-crumb-detail__time">06/01/2024</p>': "2024-01-06 00:00:00",
        '<div class="bread-crumb__detail-time"><p>07/01/2024</p></div>': "2024-01-07 00:00:00",
        '<div class="bread-crumb__detail-time">08/01/2024</div>': "2024-01-08 00:00:00",
        '<i data-role="publishdate">09/01/2024</i>': "2024-01-09 00:00:00",
        '<div class="detail-time"><div>10/01/2024</div></div>': "2024-01-10 00:00:00", '<div class="detail-time">11/01/2024</div>': "2024-01-11 00:00:00",
        "<span class='date x'>12/01/2024</span>": "2024-01-12 00:00:00", '<p class="time-now">13/01/2024</p>': "2024-01-13 00:00:00",
        '<script type="application/ld+json">{"datePublished": "2024-01-14T05:06:07Z"}</script>': "2024-01-14 05:06:00",
        '<meta itemprop="datePublished" content="2024-01-15">': "2024-01-15 00:00:00", '<p class="date">16/01/2024</p>': "Unknown",
    }
    date = lambda x: dates.render_date(page_fields.publish_date(F.lit("https://h/x"), x))
    assert values(date, list(pages), parse) == list(pages.values())
    from_url = lambda x: dates.render_date(page_fields.publish_date(x, f"cast(array() AS {ArrayType(ROW).simpleString()})"))
    assert values(from_url, ["https://h/2024/02/03/t.html", "https://h/2024/13/03/t.html", "https://h/1"]) == ["2024-02-03 00:00:00", "Unknown", "Unknown"]


def test_links_as_pages_write_them(spark):
    page = """<base href="/sub/"><a href="/it's-here.html">1</a><a href=/plain.html>2</a><!-- <a href="/no.html">3</a> --><a name="x">4</a>
      <a class='c' href='q&amp;a.html'>5</a><script>"<a href='/js.html'>"</script>"""
    from broadsheet.operators import frontier

    df = spark.createDataFrame([(1, "https://h.com/a", page), (2, "https://h.com/b", None)], "page_id bigint, url string, html string")
    rows = frontier.links(df).orderBy("position").collect()
    assert [r["href"] for r in rows] == ["/it's-here.html", "/plain.html", "q&a.html"]
    assert {r["target"] for r in frontier.page_links(df).collect()} == {
        "https://h.com/it's-here.html", "https://h.com/plain.html", "https://h.com/sub/q&a.html"}


def test_all_references_are_decoded(values):
    page = "<h1>Vi&#7879;t Nam &agrave; &hellip;</h1><article><p>&#x110;&ocirc;&nbsp;&lt;b&gt;</p></article>"
    assert values(html.page_title, [page], parse) == ["Việt Nam à …"]
    assert values(html.page_text, [page, None], parse) == ["Đô <b>", ""]
