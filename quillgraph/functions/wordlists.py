"""Words, prefixes and rules whose exact form decides results."""

# Words that token overlap ignores.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been that this it as if not no do does did has have had "
    "can could will would shall should may might must so than then all each every any some such what which who how when where"
).split()

# Name prefixes of callable entry points, with their words.
CALL_PREFIXES = {"do_": "command", "spell_": "spell", "spec_": "special"}

# Id prefix of each entity kind; any other kind is "sym".
ID_PREFIX_BY_KIND = {"function": "fn", "define": "fn", "variable": "var", "class": "cls", "struct": "cls", "file": "file"}

# Programming terms that name analysis ignores.
PLAIN_TERMS = (
    "get set init create delete update check is has value data index type size count new add remove first last next prev start end find "
    "search sort max min begin finish done load save open close"
).split()

# Domain terms that make a rationale specific.
DOMAIN_TERMS = (
    "damage spell magic combat character player mobile mob room area effect affect buff debuff weapon skill level experience hit attack "
    "defense poison heal cure cast ability stat attribute condition mortal immortal deity mana hitpoint movement fight flee death respawn "
    "save resist immunity vulnerability flag bitvector tick pulse act command do_ spell_ spec_ clan guild race class alignment karma "
    "reputation quest auction shop object item container wear wield inventory equipment"
).split()

# Keywords of each subsystem class, in the order that breaks ties.
CLASS_KEYWORDS = {
    "Interface": "display input output terminal screen message print prompt command menu window console user client socket network protocol packet connection comm".split(),
    "Core": "game player character mob npc combat fight spell skill item object room area world quest mission event action time trigger script effect stat attribute".split(),
    "Data": "data storage file database save load persist record table json xml config setting profile account db".split(),
    "Support": "util helper common tool service manager factory builder handler processor logger debug error format".split(),
    "Extension": "module plugin extension addon feature script dynamic custom hook event".split(),
}

# A dependency's type follows from the target's type; a pair with an unknown type is "requires".
CAPABILITY_TYPES = "domain policy projection infrastructure utility".split()
EDGE_TYPE_BY_TARGET = {
    "domain": "requires_core",
    "policy": "requires_policy",
    "projection": "requires_projection",
    "infrastructure": "requires_infrastructure",
    "utility": "uses_utility",
}
