"""Element text by id: nesting, attributes in any order and quoting, entities, odd pages."""

from orchard.functions.html import with_element_text

PAGES = {
    '<div id="p">Rs. 10</div>': "Rs. 10",
    "<b><DIV class='x' ID = 'p' data-a=1>a<div>b<div>c</div></div>d</DIV>e</b>": "abcd",
    '<span id=p>x &lt;y&gt; &amp;lt; &#233;&#x1F600; &#0; &nbsp;z</span>': "x <y> &lt; é\U0001F600 &#0;  z",
    '<!-- <p id="p">no</p> --><script>"<p id=\'p\'>"</script><p id="p">yes<br>and<style>p{}</style> no</p>': "yesand no",
    '<div id="q">no</div><div data-id="p">no</div>': None,
    '<div id="pp">no</div><div id="p"><p/>one</div>': "one",
    '<div id="p">open <div>never</div> closed': "open never closed",
    '<img id="p" src=x>text': "",
    '<p id="p"></p>text': "",
    "": None,
    "no tags & no ids < here": None,
    None: None,
    '<ul id="p">' + "<li>x</li>" * 20_000 + "</ul>tail": "x" * 20_000,
}


def test_element_text(spark):
    rows = list(enumerate(PAGES))
    df = spark.createDataFrame(rows, "n int, html string").withColumnRenamed("n", "at").repartition(3)
    got = {r["at"]: r["value"] for r in with_element_text(df, "html", "p", "value").collect()}
    assert got == {i: PAGES[h] for i, h in rows}
    assert with_element_text(df.where("false"), "html", "p", "value").collect() == []
