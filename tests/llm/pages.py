"""Pages written by hand, few of them with telling names, and the blocks of their articles."""

from __future__ import annotations

PAGES: list[tuple[str, list[str]]] = [
    (
        """<html><head><title>Bridges</title></head><body bgcolor=white><table width=100%><tr><td><a href="/">Start</a> | <a href="/b">Bridges</a> | <a href="/t">Tunnels</a> | <a href="/m">Mail</a></td></tr>
<tr><td><h1>The stone bridge at Alden</h1><p>The bridge was built between 1742 and 1747 by masons from the next valley, who cut the stone from a quarry two miles upstream.
<p>It has five arches, of which the middle one is the widest. In the flood of 1816 two of them fell, and were rebuilt within a year.
<p>Today only people on foot may cross it.</td></tr><tr><td align=center><font size=1>Last changed in March. Send remarks to the <a href="mailto:x">keeper of these pages</a>.</font></td></tr></table></body></html>""",
        ["The stone bridge at Alden", "The bridge was built between 1742 and 1747 by masons from the next valley, who cut the stone from a quarry two miles upstream.", "It has five arches, of which the middle one is the widest. In the flood of 1816 two of them fell, and were rebuilt within a year.", "Today only people on foot may cross it."],
    ),
    (
        """<body><div><div><a href=/>Kitchen Notes</a></div><div><a href=/soups>Soups</a><a href=/bread>Bread</a><a href=/sweets>Sweets</a><a href=/about>About</a></div></div>
<div><div><h2>Rye bread with caraway</h2><div>This loaf needs a day and a half, nearly all of it waiting. Begin in the evening with the sour, and bake the next afternoon.</div>
<ul><li>500 g of rye flour</li><li>a spoon of caraway seed</li><li>350 ml of warm water</li></ul>
<ol><li>Stir the sour with half of the flour and all of the water, and leave it covered overnight.</li><li>Work in the rest, shape a loaf and let it rise for three hours.</li><li>Bake it hot for ten minutes and then gently for fifty.</li></ol></div>
<div><h4>You may also like</h4><a href=/1>Onion soup</a><br><a href=/2>Plum cake</a><br><a href=/3>Barley stew</a></div></div>
<div>&copy; 2014 Kitchen Notes. <a href=/legal>Legal</a> <a href=/privacy>Privacy</a></div></body>""",
        ["Rye bread with caraway", "This loaf needs a day and a half, nearly all of it waiting. Begin in the evening with the sour, and bake the next afternoon.", "500 g of rye flour", "a spoon of caraway seed", "350 ml of warm water", "Stir the sour with half of the flour and all of the water, and leave it covered overnight.", "Work in the rest, shape a loaf and let it rise for three hours.", "Bake it hot for ten minutes and then gently for fifty."],
    ),
    (
        """<!doctype html><body><header><p>The Harbour Gazette</p><nav><ul><li><a href=a>News</a><li><a href=b>Weather</a><li><a href=c>Tides</a></ul></nav></header>
<main><h1>Ferry to run on Sundays again</h1><p>After three years without a Sunday boat the council voted on Tuesday to pay for one until the end of October.</p>
<aside><p>Sign up for our morning letter and never miss a tide.</p><form><input><button>Sign up</button></form></aside>
<p>“People here have waited long enough,” said the harbour master, who had asked for the boat every spring.</p><blockquote>We will sail in any wind but a northerly.</blockquote>
<p>Tickets cost the same as on other days.</p></main>
<section id="comments"><h3>2 comments</h3><p><b>Jo:</b> About time!</p><p><b>Sam:</b> Will there be room for bicycles this year?</p></section><footer><p>Printed and published in the old net loft.</p></footer></body>""",
        ["Ferry to run on Sundays again", "After three years without a Sunday boat the council voted on Tuesday to pay for one until the end of October.", "“People here have waited long enough,” said the harbour master, who had asked for the boat every spring.", "We will sail in any wind but a northerly.", "Tickets cost the same as on other days."],
    ),
    (
        """<div id=wrap><div id=top><a href=#>Accueil</a> · <a href=#>Plantes</a> · <a href=#>Contact</a></div><div id=text><h1>La culture du lin</h1>
<p>Le lin se sème au printemps, dès que la terre est assez sèche pour être travaillée, et se récolte cent jours plus tard.</p>
<h2>Le rouissage</h2><p>On laisse les tiges couchées sur le champ, où la rosée et la pluie défont peu à peu ce qui tient les fibres ensemble.</p><p>Il faut les retourner une fois au moins.</p></div>
<div id=bas>Mentions légales — <a href=#>Plan du site</a></div></div>""",
        ["La culture du lin", "Le lin se sème au printemps, dès que la terre est assez sèche pour être travaillée, et se récolte cent jours plus tard.", "Le rouissage", "On laisse les tiges couchées sur le champ, où la rosée et la pluie défont peu à peu ce qui tient les fibres ensemble.", "Il faut les retourner une fois au moins."],
    ),
    (
        """<body><div class=a1><div class=b7><a href=/>docs</a><a href=/api>api</a><a href=/faq>faq</a></div><div class=c3><h1>Installing the meter</h1><p>Before you begin, switch off the supply and make sure that nobody can switch it on again.</p>
<h3>Tools</h3><ul><li>A flat screwdriver</li><li>Side cutters</li></ul><p>Strip eight millimetres of each wire, push it into its clamp, and pull at it to see that it holds.</p><table><tr><td>L</td><td>brown</td></tr><tr><td>N</td><td>blue</td></tr></table><p>Then close the lid.</p></div>
<div class=d9><p>Was this page of use to you? <a href=y>Yes</a> <a href=n>No</a></p></div></div></body>""",
        ["Installing the meter", "Before you begin, switch off the supply and make sure that nobody can switch it on again.", "Tools", "A flat screwdriver", "Side cutters", "Strip eight millimetres of each wire, push it into its clamp, and pull at it to see that it holds.", "L", "brown", "N", "blue", "Then close the lid."],
    ),
    (
        """<body><script>var x = "<p>not text</p>";</script><div role=banner>Wanderwege im Tal</div><div role=navigation><a href=1>Routen</a> <a href=2>Karten</a> <a href=3>Hütten</a></div>
<article><header><h1>Zum Wasserfall über den Kammweg</h1></header><section><p>Der Weg beginnt hinter der Kirche und steigt gleich steil durch den Wald an; nach einer Stunde ist der Kamm erreicht.</p><p>Von dort sieht man an klaren Tagen bis zu den Seen.</p></section>
<section><h2>Rückweg</h2><p>Wer nicht umkehren will, geht am Bach entlang hinunter und nimmt im Dorf den Bus.</p></section></article><div role=complementary><p>Anzeige: Wanderschuhe jetzt mit zwanzig Prozent Rabatt!</p></div><div role=contentinfo>Impressum</div></body>""",
        ["Zum Wasserfall über den Kammweg", "Der Weg beginnt hinter der Kirche und steigt gleich steil durch den Wald an; nach einer Stunde ist der Kamm erreicht.", "Von dort sieht man an klaren Tagen bis zu den Seen.", "Rückweg", "Wer nicht umkehren will, geht am Bach entlang hinunter und nimmt im Dorf den Bus."],
    ),
]
