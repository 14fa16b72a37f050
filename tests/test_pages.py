import pytest

from rosterlake.sources import dom, pages

URL = "https://physics.example.edu/people"
CARDS = {
    "mit_faculty_cards": '<div class="card faculty-card"><h3><a href="/ann">Ann Lee</a></h3><p class="faculty-card__job-title">Professor of Physics</p>ann@example.edu</div>',
    "mit_dmse_cards": '<div class="faculty-teaser"><a href="/ann"><span class="faculty-teaser__name">Ann Lee</span></a><div class="faculty-teaser__title">Professor of Physics</div> ann@example.edu</div>',
    "stanford_hb_cards": '<div class="hb-card hb-vertical-card"><div class="hb-card__title"><a href="/ann">Ann Lee</a></div><div>Professor of Physics</div><p>ann@example.edu</p></div>',
    "berkeley_people_table": '<table><tr><th>Name</th></tr><tr><td><a href="/ann">Ann Lee</a></td><td>Professor of Physics</td><td>Faculty</td><td>ann@example.edu</td></tr><tr><td><a href="/bob">Bob Ray</a></td><td>Manager</td><td>Staff</td></tr></table>',
    "caltech_people_listing": '<div class="person-listing__person-row"><a class="person-listing__person-row__wrapper-link" href="/ann"><h2 class="person-listing__summary__title">Ann Lee</h2></a><div class="person-listing__summary__faculty-title">Professor of Physics</div>ann@example.edu</div>',
    "princeton_content_list": '<div class="content-list-item"><span class="field--name-title"><a href="/ann">Ann Lee</a></span><div class="field--name-field-ps-people-position"><div class="field__item">Professor of Physics</div></div>ann@example.edu</div>',
    "penn_people_rows": '<div class="views-row"><h3><a href="/ann">Ann Lee</a></h3><p class="title"><span class="title">Professor of Physics</span></p><span class="email"><a>ann@example.edu</a></span></div>',
    "ucla_faculty_table": '<table><tr><td><h5>Ann Lee</h5><p>Professor of Physics<br>Office 1</p><script>var name = "ann"; var domain = "example.edu";</script><a href="mailto:x@y.zz">m</a><a href="/ann">Site</a></td></tr></table>',
    "umd_k2_faculty": '<div class="catItemView groupPrimary"><h3 class="catItemTitle"><a href="/ann">Ann Lee</a></h3><span class="catItemExtraFieldsLabel">Title:</span><span class="catItemExtraFieldsValue">Professor of Physics</span><span class="catItemExtraFieldsLabel">E-mail:</span ><span class="catItemExtraFieldsValue">ann@example.edu</span></div>',
    "washington_views_rows": '<div class="thin-top-border-gray views-row"><div class="views-field-title"><a href="/ann">Ann Lee</a></div><div class="views-field-field-job-title"><span class="field-content">Professor of Physics</span></div><div class="views-field-field-email"><a href="mailto:ann@example.edu">ann@example.edu</a></div><div class="views-field-term-node-tid">Quantum optics</div></div>',
    "northwestern_people_articles": '<article class="people"><h3><a href="/ann">Ann Lee (on leave)</a></h3><p class="title">Professor of Physics</p><a href="mailto:ann@example.edu">ann@example.edu</a></article>',
    "wisc_faculty_cards": '<div class="faculty-member"><a class="faculty-name" href="/ann">Ann Lee</a><p class="position-title">Position title: Professor of Physics</p>ann@example.edu</div>',
    "uchicago_people_list": '<ul><li class="mix faculty"><a href="/ann"><div class="people_img"><h5>Ann Lee</h5></div></a><div class="people_content"><h3><span>Ann Lee</span><b>Professor of Physics</b></h3>ann@example.edu</div></li></ul>',
    "yale_people_table": '<table class="views-table"><tr><td class="views-field-name"><a class="username" href="/ann">Ann Lee</a><br>Professor of Physics</td><td>ann@example.edu</td></tr></table>',
    "ucsb_directory_rows": '<div class="views-row"><div class="group-second"><h3><a href="/ann">Ann Lee</a></h3><div>Professor of Physics</div></div><div>ann@example.edu</div><div class="group-third">Strings and branes</div></div>',
    None: '<ul><li class="x"><a href="/ann">Ann Lee</a><br>Professor of Physics, ann@example.edu</li><li><a href="/bob">Bob Ray</a> Postdoc</li><li>A professor</li></ul>',
}


@pytest.mark.parametrize("hint", list(CARDS))
def test_layouts(hint):
    (e,) = pages.roster_entries(f"<html><body>{CARDS[hint]}{CARDS[hint]}</body></html>", URL, hint)
    assert e["name"] == "Ann Lee" and e["normalized_name"] == "ann lee" and e["title"].startswith("Professor of Physics")
    assert e["email"] == "ann@example.edu" and e["profile_url"] == "https://physics.example.edu/ann" and e["source_url"] == URL
    assert "Ann Lee" in e["source_snippet"]
    if hint in ("washington_views_rows", "ucsb_directory_rows"):
        assert e["profile_text"] in ("Quantum optics", "Strings and branes")


def test_grid_without_titles():
    (e,) = pages.roster_entries('<div class="people"><ul class="grid"><li><div class="p-name"><a href="/a">Ann Lee</a></div></li><li><h3><a href="/x">Solo</a></h3></li></ul></div>', URL, "gatech_people_grid")
    assert (e["name"], e["title"], e["email"]) == ("Ann Lee", None, None)


def test_stanford_fallback_title():
    page = '<div class="hb-card hb-vertical-card"><h3><a href="/a">Ann Lee</a></h3><p class="field-content">Office 3</p><p class="field-content">Assistant Professor</p></div>'
    assert pages.roster_entries(page, URL, "stanford_hb_cards")[0]["title"] == "Assistant Professor"


def test_generic_cards_take_the_first_kind_that_yields():
    page = '<div class="person"><a href="/a">Ann Lee</a> Professor</div><li><a href="/b">Bob Ray</a> Professor</li>'
    assert [e["name"] for e in pages.roster_entries(page, URL)] == ["Ann Lee"]
    assert pages.roster_entries("", URL) == [] and pages.roster_entries("<li>professor", URL, "unknown_hint") == []


def test_pagination():
    page = '<a href="?page=1">2</a><a href="/people?page=2#top">3</a><a href="?page=1">2</a><a href="/other?page=1">x</a><a href="https://else.example/people?page=3">y</a><a href="?q=1">z</a>'
    assert pages.further_pages(page, URL) == [f"{URL}?page=1", f"{URL}?page=2"]


def test_profiles():
    bio = "Works on quantum optics and on the theory of light since the year 2001"
    p = pages.profile_of(f'<main><div class="person-title">Professor</div><div class="profile-bio">{bio}</div><p>ann@example.edu</p></main>', URL)
    assert p == {"title": "Professor", "email": "ann@example.edu", "profile_text": bio, "source_url": URL, "source_snippet": "Professor"}
    q = pages.profile_of(f"<main><h1>Ann Lee</h1><p>Associate Professor of Physics</p><p>{bio}</p><p>Contact info and office phone of the person named above here</p><p>short one</p></main>", URL)
    assert q["title"] == "Associate Professor of Physics" and q["profile_text"] == bio and q["email"] is None
    assert pages.profile_of("", URL)["title"] is None


def test_enrichment_needs_something_new():
    e = pages.roster_entries('<li><a href="/a">Ann Lee</a> professor</li>', URL)[0]
    assert pages.enrich(e, "<p>nothing</p>", "u") is e and pages.enrich(e, None, "u") is e
    more = pages.enrich(e, "<p class=person-title>Full Professor</p><p>a@b.org</p>", "https://p")
    assert (more["title"], more["email"], more["source_url"]) == ("Full Professor", "a@b.org", "https://p")


def test_selectors():
    root = dom.parse('<div id=a class="x y"><p>1</p><p class=z>2</p><span><p>3</p></span></div><p>4<br>5</p><script>no</script>')
    text = lambda s: [n.text() for n in root.select(s)]
    assert text("p") == ["1", "2", "3", "4 5"] and text("#a > p") == ["1", "2"] and text(".x.y p.z, span p") == ["2", "3"]
    assert text("p + p") == ["2"] and text("[id=a] span *") == ["3"] and text("[class^='x ']") == ["1 2 3"] and text(".q") == []
    assert "no" not in root.text()


def test_over_a_table(spark):
    rows = [(1, URL, CARDS[None], None), (2, URL, None, None), (3, None, CARDS["penn_people_rows"], "penn_people_rows")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, parser_hint string")
    assert sorted((r["page_id"], r["name"]) for r in pages.rosters(df).collect()) == [(1, "Ann Lee"), (3, "Ann Lee")]
    assert pages.profiles(df).count() == 3 and pages.pagination(df).count() == 0
