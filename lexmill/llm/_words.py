"""Fixed word lists of the heuristics."""

#: Function words (determiners, pronouns, prepositions, conjunctions, auxiliaries, particles). Fixed values.
ENGLISH = """a an the and or but nor of in on at to for with from by as is are was were be been being am i you he she it we
they me him us them my your his her its our their this that these those not no do does did done have has had having can
could will would shall should may might must if when while because so than then who whom whose which what where why how
there here more most very also all some any each every both few many much other another such only own same too just even
ever never always often still yet already again once about into onto over under between through during before after above
below up down out off near next behind without within against among across along around since until upon per although
though unless whether either neither nobody everybody somebody anybody nothing everything something anything let us
please don't doesn't didn't can't cannot couldn't won't wouldn't isn't aren't wasn't weren't i'm it's that's""".split()

GERMAN = """der die das den dem des ein eine einen einem einer eines und oder aber von vom mit zu zum zur im in am an auf
aus bei für durch gegen ohne um nach vor über unter zwischen ist sind war waren sein bin bist ich du er sie es wir ihr mich
mir dich dir ihm ihn uns euch ihnen mein meine meinen meiner dein sein seine ihre unser nicht kein keine wenn weil dass ob
als wie was wer wo man viel viele sehr auch noch nur schon mehr hat haben habe hatte wird werden wurde kann können muss
müssen möchte soll will darf etwas alle dieser diese dieses danach dabei hier dort""".split()

#: Function words of further languages. Fixed values.
FRENCH = """le la les un une des du de et ou mais dans sur avec pour par sans est sont était ai as a avons ont je tu il elle nous
vous ils elles mon ma mes son sa ses ce cette ces qui que quoi dont ne pas plus très aussi au aux en y se si comme quand""".split()
SPANISH = """el la los las un una unos unas de del y o pero en con por para sin es son era está están he ha han yo tú él ella
nosotros ellos mi mis su sus este esta estos que quien no más muy también al se si como cuando porque donde""".split()
ITALIAN = """il lo la i gli le un uno una di del della dei e o ma in nel nella con per da senza è sono era ho ha hanno io tu lui
lei noi voi loro mio mia suo sua questo questa che chi non più molto anche al alla si se come quando perché dove""".split()

#: Pronouns and finite auxiliaries: hardly a sentence goes without, hardly a list has one. Fixed values.
VERBAL = """i you he she it we they me him us them this that these those who which what there here is are was were am be been
has have had do does did can could will would should must may might don't doesn't didn't can't cannot couldn't won't it's
i'm ich du er sie es wir ihr mich mir man das dass ist sind war waren bin bist hat haben habe hatte wird werden wurde kann
können muss müssen möchte soll will darf je tu il elle nous vous ils j'ai c'est n'est d'un d'une l'on qu'il qu'elle ce est sont était ai ont qui que yo él ella es son era
está ha han he nosotros io lui lei noi è sono ho hanno che""".split()

#: Words that call for a noun phrase, and the few function words that may follow them. Fixed values.
DETERMINERS = "the a an my your his our their".split()
AFTER_DETERMINER = "other same few more most very only next many own little such just even ever less least near above must both all".split()
#: Prepositions, and words that hardly follow them: subjects, finite auxiliaries and conjunctions. Fixed values.
PREPOSITIONS = "of in at from with into on by".split()
NOT_AFTER_PREPOSITION = "i he she we they is are was were has have had do does did will would can could should must and but or because if than so of".split()
#: Possessives and verb forms besides VERBAL; words outside both link the parts of a sentence. Fixed values.
PRONOMINAL = "my your his her its our their whom whose be been being done doing having shall never let us please mein meine meinen meiner dein sein seine ihre unser".split()
