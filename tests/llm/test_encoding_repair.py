import pytest

from halyard.llm.encoding_repair import garbled_fields, repair, restored_fields

CLEAN = ["مرفأ UJ725812", "AT kØGE. nOON", "Kårstø og Ålesund – «æøå»", "¿Podrían confirmar 13°42′S?", "√ tanks dry", "INFORMAÇÃO DE NAVEGAÇÃO", "Größe 12 m³ ±2", "Добрый день, Сёстры", "Το τιμολόγιο", "£6669 per hour", "l’échantillon n° 4", "東京 港", "5 µm", "CAFÉ « fermé »", "Łódź, Świnoujście, węże"]


@pytest.mark.parametrize("text", CLEAN)
def test_correct_text_is_left_alone(text):
    assert repair(text) == (False, text)


@pytest.mark.parametrize("text", ["Kårstø – Göteborg", "Простой составил 55 часов", "σημείωση", "Świnoujście", "prix 5 €", "l’échantillon"])
@pytest.mark.parametrize("read_as", ["latin-1", "cp1252", "mac_roman", "cp850"])
def test_round_trip(text, read_as):
    try:
        bad = text.encode("utf-8").decode(read_as)
    except UnicodeDecodeError:
        pytest.skip("these bytes can't be read so")
    assert repair(bad) == (True, text)


def test_nested_layers_and_single_bytes():
    twice = "Brunsbüttel – Löschhafen".encode().decode("cp1252").encode().decode("cp1252")
    assert repair(twice) == (True, "Brunsbüttel – Löschhafen")
    assert repair("Für Køge benötigen wir zusätzlich".encode("cp1252").decode("cp437")) == (True, "Für Køge benötigen wir zusätzlich")
    assert repair("Просим проверить".encode("cp1251").decode("cp1252"))[0]
    assert repair("K�ge / M�laga")[0]
    assert repair("K&Atilde;¥re")[1] == "Kåre"


def test_table(spark):
    rows = [("a", "Ã…lesund", None, 1), ("a", "Ã…lesund", None, 2), ("b", "", "ok", 3), ("c", None, "Ålesund " * 5000 + "Ã¥", 4), (None, "Ã¥", "x", 5)]
    df = spark.createDataFrame(rows, "email_id string, subject string, body_text string, field_name int")
    found = garbled_fields(df, "email_id", ["subject", "body_text"]).collect()
    assert {tuple(r) for r in found} == {("a", "subject"), ("c", "body_text"), (None, "subject")} and len(found) == 3
    assert {(r.record_id, r.restored[-3:]) for r in restored_fields(df, "email_id", ["subject"]).collect()} == {("a", "und"), (None, "å")}
    assert garbled_fields(df.limit(0), "email_id", ["subject"]).count() == 0


def test_only_a_drop_of_cost_is_taken():
    for s in ("ÄÖÜäöüß", "áéíóúüñ", "Ærø å ø", "à é ó", "Straße, Grüße", "Πειραιάς и Одесса", "ÉÈÊ àâç"):
        assert repair(s) == (False, s)
    from halyard.llm.encoding_repair import _total, run_verdict

    for run in ("Ã©", "â€™", "Ð´Ð¾Ð¼", "ÃƒÂ©", "é", "ß"):
        garbled, text, first = run_verdict(run, "a", "b")
        assert (first is None) == (text == run) and (first is None or _total(text, "a", "b") < _total(run, "a", "b"))


def test_layers_have_no_bound():
    s = "Kårstø – prêt"
    for n in range(1, 9):
        t = s
        for _ in range(n):
            t = t.encode().decode("latin-1")
        assert repair(t) == (True, s), n


def test_lost_and_single_signs():
    assert repair("Fujairah û arrival")[1] == "Fujairah – arrival"
    assert repair("Bonjour Ã  tous")[0] and repair("The vesselâ  s draft")[0] and not repair("Bom dia à todos")[0]
