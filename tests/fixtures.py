"""Small pages of our own, with expectations worked out by hand."""

# A seed catalogue: three entries of one kind, furniture around them.
SEED_PAGE = """<html><head><title>Seeds</title></head><body>
<nav><a href="/roots">Roots</a><a href="./leaves">Leaves</a></nav>
<main id="list">
  <section class="entry" id="s1"><h3 class="sort">Purple carrot seeds</h3><em class="cost">€2.40</em>
    <p class="note">Sow outdoors from March on, thin to a hand's width.</p></section>
  <section class="entry" id="s2"><h3 class="sort">Curly kale seeds</h3><em class="cost">€3.10</em>
    <p class="note">Hardy plants that taste best after the first frost.</p></section>
  <section class="entry" id="s3"><h3 class="sort">Yellow beetroot seeds</h3><em class="cost">€2.75</em>
    <p class="note">Soak overnight, sow in rows a foot apart.</p></section>
</main></body></html>"""

# Three library pages that show their titles in three different ways.
LIBRARY_PAGES = [
    "<html><body><dl><dt class='work'>Tides and Moons</dt><dd>1931</dd><dt class='work'>A Book of Kites</dt><dd>1950</dd></dl></body></html>",
    "<html><body><h2>On Walking Slowly</h2><h2>Bread for Beginners</h2><p>Two loans</p></body></html>",
    "<html><body><h1>The Salt Road</h1><p>On the shelf</p></body></html>",
]

# Prices stand beside names in a table.
FARE_PAGE = """<html><body><table>
<tr><td class="stop">Harbour</td><td class="price-cell">$4</td></tr>
<tr><td class="stop">Old Mill</td><td class="price-cell">$6</td></tr>
<tr><td class="stop">Castle</td><td class="price-cell">$9</td></tr></table></body></html>"""
FARE_TASK = "Extract prices"

# Text to keep as it is, text to squeeze, things to drop.
NOTES_PAGE = """<html><head><meta charset="utf-8"><title>  Field   notes </title><style>b { color: red }</style></head>
<body><!-- draft --><h1 class="head">Birds   seen</h1>
<pre class="table  wide">
 wren   2
 <b> robin   1 </b>  owl
</pre><textarea>  as   typed </textarea>
<p title="two  blanks">By the   <i> river </i> at
 noon&nbsp;&amp; later</p><script>if (1 < 2) { run() }</script><noscript>no</noscript></body></html>"""

URLS = [
    "https://garden.test",
    "https://shop.garden.test/tools/rake?size=2#top",
    "http://192.168.7.1/admin",
    "garden dot example",
    "gopher://garden.test/",
    "https://garden.test/two words",
    "https://Garden.test:443/a/b/",
]
