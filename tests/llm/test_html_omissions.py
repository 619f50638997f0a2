"""Pages whose visible text once was lost: heads that end by themselves, drawings, formulas, old listings, rules for other media."""

import pytest

from sparkloom.llm.html_render import extract

CASES = {
    "body ends the head": ("<html><head><title>t</title><style>i{}</style><body><p>x<p>y", "x\n\ny"),
    "an element ends the head": ("<head><meta charset=utf-8><link rel=a><script>no</script><h1>x</h1>y", "x\n\ny"),
    "text ends the head": ("<head><title>t</title>\n x <b>y</b>", "x y"),
    "blanks and comments do not": ("<head> <!-- c --> <template><p>no</p></template><noscript><img alt=no></noscript>\n</head>x", "x"),
    "a second head": ("<p>x<head><p>y", "x\n\ny"),
    "svg": ("<p>a<svg><title/><desc>no</desc><defs/><rect/><text>b</text><text>c<tspan>d</tspan></text><symbol><text>no</text></symbol></svg>e", "a b cd e"),
    "math": ("<p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn><annotation>no</annotation></math> holds", "so x=2 holds"),
    "hidden svg": ("<svg style='display:none'><text>no</text></svg><svg aria-hidden=true><text>no</text></svg>x", "x"),
    "xmp": ("<p>a<xmp>if  <b> &amp;\n  c</xmp>d", "a\n\nif  <b> &amp;\n  c\n\nd"),
    "print": ("<style>@media print{nav{display:none}.q{display:none}}</style><nav>x</nav><b class=q>y</b>", "x\ny"),
    "rules behind print": ("<style>@media print{a{color:red}} .q{display:none}</style>x<b class=q>no</b>", "x"),
    "screen": ("<style>@import 'a;b'; @media screen{.q{color:red;display:none}}</style>x<b class=q>no</b>", "x"),
    "some screens": ("<style>@media screen and (max-width:9em){.q{display:none}}@media not screen{.q{display:none}}</style><b class=q>x</b>", "x"),
    "all screens": ("<style>@media print, screen{.q{display:none}}@media not print{.r{display:none}}</style>x<b class=q>no</b><b class=r>no</b>", "x"),
    "media of the sheet": ("<style media=print>.q{display:none}</style><b class=q>x</b><style media='all'>.r{display:none}</style><b class=r>no</b>", "x"),
    "nested at-rules": ("<style>@media print{@supports (display:grid){.q{display:none}}}@supports (a:b){@media all{.r{display:none</style><b class=q>x</b><b class=r>no</b>", "x"),
    "braces in strings": ("<style>.a::before{content:'}@media print{'}.q{display:none}</style>x<b class=q>no</b>", "x"),
}


@pytest.mark.parametrize("name", CASES)
def test_visible_text_is_kept(name):
    html, want = CASES[name]
    assert extract(html) == want
