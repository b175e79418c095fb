"""Function words of languages and what they tell about a text's language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words by language; single plain letters, which also mark list items, are left out but for English.
FUNCTION_WORDS = {
    "en": "the a an of to in and for on at by with from is are be was were shall must may will should would can which that this it its them they any each every no not under above after before during while where unless if or as has have had been within without into than but all we you he she his her their there what when who how yes i",
    "ar": "في من على إلى عن أن إن فإن بعد قبل خلال لدى مع دون بموجب بشأن كل هذا هذه ذلك التي الذي الذين عند ثم إذا نحو بين فوق تحت كان كانت لها له عليها عليه أو لا ما قد لم لن به وفي ومن وعلى حتى حيث كما فور رقم لسنة لذلك وذلك تم يتم أي هل هي هو",
    "fr": "le la les des du une un est dans pour selon doit peut par sur avec sans avant chaque qui aux cette ou ses dès et ne pas à au ce que il elle nous vous sont être ont été plus après même leur leurs son sa lorsque entre",
    "de": "der die das und ist nicht ein eine einer eines einem einen zu den dem des von mit für auf im in als auch sich dass werden wird wurde bei nach aus oder aber wenn muss müssen kann können sind war haben hat durch über unter vor zwischen jede jeder jedes wir sie er es ich kein keine nur noch",
    "es": "el la los las un una unos unas de del en que es son no se por para con sin su sus al lo como más pero o este esta estos estas debe deben puede pueden ser ha han cada cuando entre hasta desde sobre antes después según si hay está le les",
    "it": "il lo la gli le un una di del della dei delle è che non per con da dal nel nella si sono come più ma deve devono può possono essere ha hanno ogni quando tra fino su prima dopo se al alla",
    "pt": "os as um uma de do da dos das em no na que é são não se por para com sem seu sua ao como mais mas ou este esta deve devem pode podem ser há cada quando entre até sobre antes depois segundo",
}
WORDS = {k: v.split() for k, v in FUNCTION_WORDS.items()}
#: Languages in Latin script besides English.
LATIN = ("fr", "de", "es", "it", "pt")


def function_words(words: Column) -> Column:
    """The lower-cased ``words`` that are function words of any language."""
    every = sorted({w for k in WORDS.values() for w in k})
    return F.filter(words, lambda x: x.isin(every))


def hits(words: Column, language: str) -> Column:
    """How many of the lower-cased ``words`` are function words of the language."""
    return F.size(F.filter(words, lambda x: x.isin(WORDS[language])))


def most_spoken(counts: dict[str, Column], words: Column) -> Column:
    """The language in Latin script with most function words: one in ten ``words`` and more than English has, otherwise English."""
    rated = F.greatest(*[F.struct(counts[k].alias("n"), F.lit(k).alias("l")) for k in LATIN])
    return F.when((rated["n"] > counts["en"]) & (rated["n"] * 10 >= words), rated["l"]).otherwise("en")


def latin_language(words: Column) -> Column:
    """Language of a text in Latin script; where one word in five is an English function word the others are not counted."""
    en = hits(words, "en")
    return F.when(en * 5 >= F.size(words), "en").otherwise(most_spoken({"en": en, **{k: hits(words, k) for k in LATIN}}, F.size(words)))
