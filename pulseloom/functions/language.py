"""Language identification by function words.

An approximation of a profile-based detector, kept JVM-side: each language scores one point per token
that is one of its function words, the highest score wins, ties go to the earlier language, and a text
without any function word has no detectable language.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulseloom.functions.once import bind

# Frequent function words per language.
FUNCTION_WORDS = {
    "en": "the and of to in is that it for was on are as with they at be this have from or by but not what all were when we there can an your which their if will each about how up out them then she many some so these would other into has more her like him see time could no make than been its who now my did may very after just where most",
    "fr": "le la les de des du un une et est en que qui dans pour par sur au aux avec ce ces cette il elle nous vous ils elles ne pas plus se sont ont mais ou où son sa ses leur leurs être avoir fait comme tout tous été",
    "de": "der die das und ist in den von zu mit sich auf für nicht ein eine einen einem einer als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "es": "el la los las de y en que un una por con para es se del al lo como más pero sus su no si o este esta está son entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros",
    "it": "il lo la gli le di e che un una per con non sono del della dei delle si da al alla nel nella come più ma anche questo questa ha ho è i o se ci",
    "pt": "o a os as de e que do da em um uma para com não por mais dos das como mas ao ele ela foi são também pelo pela até isso seu sua ou quando muito nos já está eu",
    "nl": "de het een en van ik te dat die in is niet op aan met als voor zijn er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze",
    "sv": "och att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla",
    "pl": "i w na z do nie się jest to że o jak za od po ale co dla przez przy są czy tak był może tylko jego jej ich oraz tym lub być już które który która także",
    "ru": "и в не на что я с он как это по но они мы она за из у же от так для вы бы до или его все был если о к только ее когда быть",
}


def _listed(words: str | list[str]) -> str:
    words = words.split() if isinstance(words, str) else words
    return "(" + ", ".join('"' + w + '"' for w in words) + ")"


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}']+")


def detect_language(text: Column, languages: dict[str, str] = FUNCTION_WORDS) -> Column:
    """Language code, or null. Written as SQL text: the word lists would be a thousand single literals otherwise."""
    known = _listed(sorted({w for listed in languages.values() for w in listed.split()}))
    scored = ", ".join(f"struct(size(filter(found, w -> w in {_listed(listed)})) as hits, {-rank} as rank, '{code}' as code)"
                       for rank, (code, listed) in enumerate(languages.items()))
    found = F.call_function("filter", tokens(text), F.expr(f"w -> w in {known}"))
    best = F.call_function("transform", F.array(found), F.expr(f"found -> array_max(array({scored}))"))
    return bind(best[0], lambda b: F.when(b["hits"] > 0, b["code"]))
