"""Stems against the published sample vocabularies."""

import pytest

from paritas.functions import stems
from paritas.operators import bias

#: Words of the published samples and their stems.
ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol
consonant conson consort consort consorted consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob
knocked knock knocker knocker knockers knocker knots knot generously generous generate generat skies sky dying die news news inning inning proceed proceed succeeded succeed gas gas this this cries cri ties tie
hoping hope hopping hop by by say say cry cri youth youth relational relat rational ration happiness happi dog's dog""".split()
SPANISH = """chicana chican chicano chican chicas chic chicharrones chicharron chichimecas chichimec chicle chicl chico chic chicos chic chicuelo chicuel chile chil chilena chilen chilenos chilen chilpancingo chilpancing
chimpancé chimpanc china chin torá tor torax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer toreros torer torio tori tormenta torment
tormentas torment tornado torn tornados torn tornar torn tornen torn torneo torne torneos torne tornillo tornill tornillos tornill torniquete torniquet torno torn toro tor toronto toront toros tor
torpedearon torped torpeza torpez torrado torr torralba torralb torre torr torrencial torrencial torrentes torrent torreón torreon torres torr torrescano torrescan""".split()


@pytest.mark.parametrize(("language", "pairs"), [("english", ENGLISH), ("spanish", SPANISH)])
def test_stems_are_those_of_the_samples(spark, language, pairs):
    expected = dict(zip(pairs[::2], pairs[1::2]))
    got = {r["word"]: r["stem"] for r in stems.stem_table(spark.createDataFrame([(w,) for w in [*expected, None]], "word string"), language).collect()}
    assert got.pop(None) is None
    assert {w: s for w, s in got.items() if s != expected[w]} == {}


def test_keywords_meet_by_their_stems(spark):
    words = spark.createDataFrame([("consoling",), ("knights",), ("zebra",)], "word string")
    concepts = spark.createDataFrame([(1, "console"), (1, "knightly"), (2, "other")], "concept_id int, word string")
    gendered = spark.createDataFrame([("knight",)], "word string")
    table = stems.stem_table(words.union(concepts.select("word")).union(gendered), "english")
    got = bias.keyword_coverage(words, concepts, gendered, table).first()
    assert got["covered"] == pytest.approx(2 / 3) and got["gendered"] == pytest.approx(0.25)
    with pytest.raises(ValueError):
        stems.stem_table(words, "klingon")
