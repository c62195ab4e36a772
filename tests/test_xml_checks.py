from lawlake.operators import documents, xml_checks

HEAD = "<a:meta><a:FRBRlanguage language='{}'/><a:references><a:TLCTerm eId='known'/></a:references></a:meta>"
DOC = "<a:akomaNtoso xmlns:a='x'><a:act>" + HEAD.format("eng") + "{}</a:act></a:akomaNtoso>"
UNIT = "<a:{0} eId='{1}'><a:content><a:p>words</a:p></a:content></a:{0}>"


def doc(body, language="eng"):
    return DOC.format(body).replace("'eng'", f"'{language}'")


def test_checks_on_the_whole_document(spark):
    quoted = "<a:mod><a:quotedStructure>" + UNIT.format("section", "q") + "</a:quotedStructure></a:mod>"
    sec = UNIT.format("section", "sec_1")
    formula = "<a:preface><a:formula name='enactingFormula' eId='f'><a:p>Be it enacted by the council</a:p></a:formula></a:preface>"
    rows = {
        "no body": doc(""), "quotes only": doc(f"<a:body>{quoted}</a:body>"), "wrapper only": doc("<a:body><a:hcontainer><a:p>x</a:p></a:hcontainer></a:body>"), "prose": doc(f"<a:body><a:p>{'word ' * 60}</a:p></a:body>"),
        "annex": doc(f"<a:body/><a:attachments><a:attachment><a:doc><a:mainBody>{sec}</a:mainBody></a:doc></a:attachment></a:attachments>"), "unit": doc(f"<a:body>{sec}</a:body>"),
        "terms": doc(f"<a:body>{sec}<a:p><a:term refersTo='#known'/><a:term refersTo='#other'/><a:term/></a:p></a:body>"), "formula": doc(f"{formula}<a:body>{sec}</a:body>", "ara"), "same script": doc(f"{formula}<a:body>{sec}</a:body>"),
        "money": doc("<a:body><a:section eId='s'><a:p>pay 500 (four hundred) or 12 (twelve)</a:p></a:section></a:body>"), "broken": "<act>", "blank": " ", "none": None,
    }
    checked = xml_checks.checked(spark.createDataFrame(list(rows.items()), "id string, akn_xml string"))
    got = sorted(tuple(r) for r in xml_checks.found(checked).collect())
    assert got == sorted(
        [(x, "empty_body", "error", None) for x in ("no body", "quotes only", "wrapper only")] + [("terms", "definition_completeness", "warning", None)] * 2
        + [("formula", "formula_script_mismatch", "error", "f"), ("money", "money_words_mismatch", "warning", "s")]
    )
    failed = {r.version_id: r.failed for r in xml_checks.verdicts(checked).collect()}
    assert (failed["broken"], failed["blank"], failed["none"], failed["unit"]) == (True, None, None, False)


def test_documents_without_units_fail_and_translations_are_compared(spark):
    two = UNIT.format("section", "sec_1") + UNIT.format("section", "sec_2")
    one, more = UNIT.format("section", "sec_1"), two + UNIT.format("section", "sec_3")
    rows = [
        ("a", None, "eng", doc(two)), ("a1", "a", "fra", doc(more)), ("a2", "a", "eng", doc(one)),  # divided; the same language
        ("b", None, "eng", doc(two)), ("b1", "b", "fra", doc(one)), ("b2", "b", "deu", "<act>"),
        ("c", None, "eng", doc(two)), ("c1", "c", "fra", None), ("c2", "c", "deu", doc(two)),
        ("d", None, "eng", doc(two)), ("d1", "d", "fra", doc(UNIT.format("section", "sec_1") + UNIT.format("section", "sec_9"))),  # same shape
        ("e", None, "eng", doc("<a:body/>")), ("e1", "e", "fra", doc(two)), ("f", None, "eng", None),
    ]
    v = spark.createDataFrame(rows, "id string, parent_version_id string, language string, akn_xml string")
    kept = {r.version_id: r.failed for r in xml_checks.translations_preserved(v).collect()}
    assert len(kept) == len(rows) and {k: kept[k] for k in "abcdef"} == {"a": False, "b": True, "c": None, "d": True, "e": None, "f": None}
    present = {r.version_id: r.failed for r in documents.structural_scan(v).where("check_name = 'body_units_present'").collect()}
    assert (present["a"], present["e"], present["b2"], present["f"]) == (False, True, None, None)
