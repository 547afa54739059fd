"""Values that decide results, in one place."""

# The eight kinds of entity.
KINDS = ("CHARACTER", "LOCATION", "NPC", "ITEM", "FACTION", "SCENE", "EVENT", "CONCEPT")

# The subtypes of each kind.
SUBTYPES = {
    "CHARACTER": ("PROTAGONIST", "ANTAGONIST", "ALLY", "NEUTRAL", "ENEMY"),
    "LOCATION": ("CONTINENT", "COUNTRY", "CITY", "TOWN", "VILLAGE", "LANDMARK", "BUILDING", "ROOM"),
    "NPC": ("MERCHANT", "GUARD", "NOBLE", "COMMONER", "MYSTIC", "WARRIOR"),
    "ITEM": ("WEAPON", "ARMOR", "ARTIFACT", "CONSUMABLE", "KEY", "TREASURE"),
    "FACTION": ("GUILD", "KINGDOM", "ORDER", "CULT", "TRIBE", "ALLIANCE"),
    "SCENE": ("OPENING", "CLIMAX", "RESOLUTION", "FLASHBACK", "BEAT", "TRANSITION"),
    "EVENT": ("BATTLE", "CEREMONY", "DISCOVERY", "BETRAYAL", "MEETING", "DEATH"),
    "CONCEPT": ("MAGIC", "PROPHECY", "CURSE", "LAW", "CUSTOM", "LEGEND"),
}

# A colour for each kind, one for others, and the folder palette's length.
COLORS = {
    "CHARACTER": "#8b5cf6",
    "LOCATION": "#3b82f6",
    "NPC": "#f59e0b",
    "ITEM": "#10b981",
    "FACTION": "#ef4444",
    "SCENE": "#ec4899",
    "EVENT": "#14b8a6",
    "CONCEPT": "#6366f1",
}
GREY = "#6b7280"

# The words that keyword counts leave out.
STOP_WORDS = tuple(
    """
    the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would
    could should may might must shall can need dare ought used it its this that these those i you he she we they me him
    her us them my your his our their mine yours hers ours theirs what which who whom whose where when why how all each
    every both few more most other some such no nor not only own same so than too very just also now here there then once
    if into through during before after above below up down out off over under again further any about
    """.split()
)

# Relationship types known from the start (label, from, to, directed).
RELATIONSHIP_TYPES = (
    ("HAS_TAG", "NOTE", "TAG", True),
    ("MENTIONS", "NOTE", "MENTION", True),
    ("CONTAINS", "FOLDER", "NOTE,FOLDER", True),
    ("LINKS_TO", "NOTE", "NOTE", True),
    ("REFERS_TO", "NOTE", "*", True),
)
