"""Readers over small awkward files."""

import random

from pyspark.sql import functions as F

from meridian.functions.white import WHITE
from meridian.sources import catalogues, tournaments


def files(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / name.replace("_", ".")).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_site_results(spark, tmp_path):
    text = 'Rank,Name,Army,W,L,VP,Roster\r\n\n1,"Ann ""A"", B",Orks,3,x,,"a, b"\nlast,Bo,Orks,1,1,1,\n 2nd ,, Elves ,2\n'
    rows = tournaments.site_results(tournaments.whole_files(spark, files(tmp_path, a_csv=text, b_csv="Rank\n", c_csv="")), tournaments.SITE_A, "Open", "2024-01-01").orderBy("placement").collect()
    assert [(r["placement"], r["player"], r["faction"], r["wins"], r["losses"], r["points"], r["list"]) for r in rows] == [(1, 'Ann "A", B', "Orks", 3, 0, 0, "a, b"), (2, None, "Elves", 2, 0, 0, None)]
    assert {r["event"] for r in rows} == {"Open"}


def test_site_b_prefers_its_own_names(spark, tmp_path):
    path = files(tmp_path, a_csv="position,player,faction,cp,vp\n4,Ann,Orks,7,9\n")
    assert [(r["placement"], r["points"]) for r in tournaments.FORMATS["site_b"](tournaments.whole_files(spark, path)).collect()] == [(4, 7)]


def test_generic_results(spark, tmp_path):
    text = "event,date,format,place,faction,player,unit,unit_games_played,avg_points\nA,d1,RTT,1,Orks,Ann,Boyz,3,90.5\nA,d1,GT,1,Orks,Other,Nobz,x,y\nA,d1,,2,Elves,Bo,,,\n,d1,GT,1,Orks,Ann,Boyz,3,90\nB,d2,,1,Orks,Cy,Boyz,1,1\n"
    rows = tournaments.generic_results(tournaments.whole_files(spark, files(tmp_path, a_csv=text))).orderBy("event", "placement").collect()
    assert [(r["event"], r["format"], r["placement"], r["player"]) for r in rows] == [("A", "RTT", 1, "Ann"), ("A", "RTT", 2, "Bo"), ("B", "", 1, "Cy")]
    assert [tuple(u) for u in rows[0]["units"]] == [("Boyz", None, 3, 90.5), ("Nobz", None, 0, 0.0)] and rows[1]["units"] is None


def test_json_rows(spark, tmp_path):
    path = files(tmp_path, a_json='[{"id": 1, "name": "x"}, {"id": 2}]', b_json='{"id": 3}', c_json="[broken", d_json="[]")
    assert sorted((r["id"], r["name"]) for r in tournaments.json_rows(spark, path, "struct<id:int,name:string>").collect()) == [(1, "x"), (2, None)]


CATALOGUE = """<catalogue><selectionEntries>
<selectionEntry id="u1" name="Boyz" type="unit"><profiles>
 <profile name="Boyz" typeName="Unit"><characteristics><characteristic name="M">6"</characteristic><characteristic name="T">5</characteristic><characteristic name="SV">5+</characteristic></characteristics></profile>
 <profile name="Tough" typeName="Abilities"><characteristics><characteristic name="Description">Has a 5+ invulnerable save and Feel No Pain (6+).</characteristic></characteristics></profile></profiles>
 <costs><cost name="pts" value="84.5"/></costs>
 <selectionEntries><selectionEntry id="w1" name="Choppa" type="upgrade"><profiles><profile name="Choppa" typeName="Melee Weapons"><characteristics>
  <characteristic name="A">2 d6</characteristic><characteristic name="WS">3+</characteristic><characteristic name="S">4</characteristic><characteristic name="AP">-1</characteristic><characteristic name="D">1</characteristic><characteristic name="Keywords">[Lethal Hits], Anti-Infantry 4+</characteristic></characteristics></profile></profiles></selectionEntry></selectionEntries>
</selectionEntry>
<selectionEntry id="u2" name="Grot" type="model"><profiles/></selectionEntry>
<selectionEntry id="" name="Nobody" type="unit"><profiles/></selectionEntry>
</selectionEntries></catalogue>"""


def test_units(spark, tmp_path):
    got = {r["id"]: r for r in catalogues.units(spark, files(tmp_path, Orks_cat=CATALOGUE, Zzz_gst=CATALOGUE.replace("Grot", "Gretchin"), x_txt="<no", y_cat="no xml")).collect()}
    boyz, grot = got["u1"], got["u2"]
    assert set(got) == {"u1", "u2"} and grot["name"] == "Gretchin" and grot["faction"] == "Zzz"
    assert (boyz["move"], boyz["toughness"], boyz["save"], boyz["wounds"], boyz["leadership"], boyz["points"], boyz["invuln"], boyz["fnp"], boyz["warnings"]) == (6, 5, 5, 1, 6, 85, 5, 6, [])
    (w,) = boyz["weapons"]
    assert (w["name"], w["range"], w["attacks"], w["skill"], w["ap"], [tuple(a) for a in w["abilities"]]) == ("Choppa", "melee", "2D6", 3, -1, [("LETHAL_HITS", 0, None), ("ANTI", 4, "Infantry")])
    assert grot["warnings"] == ["no toughness", "no save", "no weapons"]


def nested(name: str, depth: int, inner: str) -> str:
    for i in range(depth):
        inner = f'<selectionEntryGroups><selectionEntryGroup id="g{i}" name="{name}"><selectionEntries><selectionEntry id="n{i}" name="{name}" type="model">{inner}</selectionEntry></selectionEntries></selectionEntryGroup></selectionEntryGroups>'
    return inner


def profile(name: str, kind: str, **traits: str) -> str:
    return f"<profiles><profile name='{name}' typeName=\"{kind}\"><characteristics>" + "".join(f'<characteristic name="{k}">{v}</characteristic>' for k, v in traits.items()) + "</characteristics></profile><profile name='none' typeName='Unit' hidden='true'/></profiles>".replace("Unit", "Other")


def test_profiles_in_groups_at_any_depth(spark, tmp_path):
    deep = profile("Deep", "Unit", M="7&quot;", T="6", SV="3+") + nested("w", 2, profile('A &quot;B&quot; &gt; C', "Ranged Weapons", Range="24&quot;", A="3", S="5") + profile("Hidden", "Abilities", Description="A 2+ invulnerable save, Feel No Pain 2+"))
    group = f'<selectionEntryGroups><selectionEntryGroup id="s" name="s">{profile("In a group", "Melee Weapons", A="2", S="4")}</selectionEntryGroup></selectionEntryGroups>'
    entry = lambda i, inner: f'<selectionEntry id="{i}" name="{i}" type="unit">{inner}</selectionEntry>'
    text = "".join([
        entry("a", nested("m", 5, deep) + group), entry("b", profile("Save", "Invulnerable Save", none="-", value="4+") + profile("x", "Abilities", Description="5+ invulnerable save")),
        entry("c", "<rules><rule name='r'><description>Has a 3+ invulnerable save and a Feel No Pain 6+</description></rule></rules>" + profile("y", "Abilities", Description="Feel No Pain (5+)")),
    ])
    got = {r["id"]: r for r in catalogues.units(spark, files(tmp_path, a_cat=f"<catalogue><sharedSelectionEntries>{text}</sharedSelectionEntries></catalogue>")).collect()}
    a = got["a"]
    assert set(got) == {"a", "b", "c"} and (a["move"], a["toughness"], a["save"], a["warnings"], a["abilities"], a["invuln"], a["fnp"]) == (7, 6, 3, [], [], None, None)
    assert [(w["name"], w["range"], w["strength"]) for w in a["weapons"]] == [('A "B" > C', "24", 5), ("In a group", "melee", 4)]
    assert (got["b"]["invuln"], got["c"]["invuln"], got["c"]["fnp"], [x["name"] for x in got["c"]["abilities"]]) == (4, 3, 5, ["y"])


def test_an_entry_that_is_no_xml_leaves_the_others(spark, tmp_path):
    entry = '<selectionEntry id="{0}" name="{0}" type="unit"{1}>{2}</selectionEntry>\n'.format
    text = "<catalogue>" + entry("a", "", "") + entry("b", " hidden=x", "") + entry("c", "", "<costs></cost>") + entry("d", "", '<costs><cost name="pts" value="x"/></costs>') + entry("e", "", '<costs><cost name="pts" value="7"/></costs>') + "</catalogue>"
    path = files(tmp_path, a_cat=text, b_cat="", c_cat="no entries")
    assert {(r["id"], r["points"]) for r in catalogues.units(spark, path).collect()} == {("a", 0), ("d", 0), ("e", 7)}
    assert sorted(r["entry"].strip()[:22] for r in catalogues.unread_entries(spark, path).collect()) == ['<selectionEntry id="b"', '<selectionEntry id="c"']


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """No line holds another's file, and results are those of whole files, however they are split."""
    text = "\r\n  \nevent,date,format,place,faction,player,unit,avg_points\r\n" + "".join(f'E{i % 7},d,{i},{i % 3 + 1},Orks,"P ""{i}"", x",u{i},{i}\n\n' for i in range(400))
    path = files(tmp_path, a_csv=text, b_csv="Rank\n", c_csv="", d_csv="event,date,place,player\nE9,d,1,Ann")
    found = lambda read: [tuple(r[c] for c in r.asDict() if c != "line") for r in tournaments.generic_results(read(spark, path)).orderBy("event", "placement").collect()]
    want = found(tournaments.whole_files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        lines = tournaments.file_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 5 and max(len(r["text"]) for r in lines.collect()) < 80
        assert found(tournaments.file_lines) == want and len(want) == 22
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def reference_cells(line: str) -> list[str]:
    """A line's fields, read character by character."""
    out, now, quoted, i = [], "", False, 0
    while i < len(line):
        if line[i] == '"' and quoted and line[i + 1 : i + 2] == '"':
            now, i = now + '"', i + 1
        elif line[i] == '"':
            quoted = not quoted
        elif line[i] == "," and not quoted:
            out, now = [*out, now], ""
        else:
            now += line[i]
        i += 1
    return [x.strip(WHITE) for x in [*out, now]]


def test_fields_of_a_line(spark):
    """Awkward quotes, white space of all kinds, and fields so long that a pattern that goes back runs out of stack."""
    dice = random.Random(4)
    texts = ["", ",", '"', '""', '"""', '""""', '"a,b",c', 'a"b,c"d,e', '"a""b","",""""', '"abc""', 'x,"y,z', ' "a" ,　b\xa0,"\t c "', "é,\x7f a,ü ", '"' + "long, " * 40_000 + '",1', "y" * 200_000 + ',""', '"' + '""' * 50_000, " ,﻿1\r"]
    texts += ["".join(dice.choices('",a \xa0é\r', [4, 3, 3, 2, 1, 1, 1], k=dice.randrange(1, 14))) for _ in range(600)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tournaments.cells(F.col("text")).alias("cells")).collect()
    assert [r["cells"] for r in got] == [reference_cells(r["text"]) for r in got]


def test_a_line_is_cut_once(spark, tmp_path, monkeypatch):
    """Filters of fields go through the join with the headers, and took the cutting of each line along three times."""
    cells = tournaments.cells
    monkeypatch.setattr(tournaments, "cells", lambda line: cells(F.concat(line, F.lit("#cut#"))))
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        path = files(tmp_path, a_csv="event,date,place,player\nE,d,1,Ann\n")
        for rows in (tournaments.generic_results(tournaments.file_lines(spark, path)), tournaments.FORMATS["site_a"](tournaments.file_lines(spark, path))):
            # Once for headers, once for the other lines.
            assert rows._jdf.queryExecution().executedPlan().toString().count("#cut#") == 2
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_a_row_without_place_gives_the_format(spark, tmp_path):
    path = files(tmp_path, a_csv='event,date,format,place,army,player,unit\n A ,d,RTT,none,Orks,No,x\nA,d,GT,2,Orks,Ann,"Big ""Boyz"""\nA,d,GT,2,Orks,Bo, \nA,d,GT,2, Orks ,Cy,Nobz\nA,e,GT,1,Orks,,', b_csv="event,date,place\nA,d,1\n")
    for read in (tournaments.whole_files, tournaments.file_lines):
        got = tournaments.generic_results(read(spark, path)).orderBy("event_date", "placement").collect()
        assert [(r["file"][-5:], r["event_date"], r["format"], r["placement"], r["player"], r["units"] and [u["unit"] for u in r["units"]]) for r in got] == [("b.csv", "d", "GT", 1, None, None), ("a.csv", "d", "RTT", 2, "Ann", ['Big "Boyz"', "Nobz"]), ("a.csv", "e", "GT", 1, None, None)]
