"""Word lists that the scores are defined by (fixed values).

A word counts as present if it occurs anywhere in the lower-cased text, inside other words too.
"""

HIGH_VALUE = ["amazing", "incredible", "breakthrough", "important", "key", "secret", "shocking", "surprising", "reveal", "discover", "explain", "show", "first", "best", "worst", "never", "always", "must", "should"]
TEXT_ENGAGEMENT = ["important", "key", "amazing", "incredible", "you", "we"]
QUALITY_ENGAGEMENT = ["important", "key", "amazing", "incredible", "secret", "tip"]
DIRECT_ADDRESS = ["you", "your", "we", "let's"]

CLIP_ENGAGEMENT = ["amazing", "incredible", "wow", "look", "see", "watch", "important", "key", "secret", "tip", "hack", "trick", "you", "your", "we", "us", "let's", "remember"]
CLIP_PRACTICE = ["breathe", "inhale", "exhale", "stretch", "hold", "feel", "move", "shift", "come into", "transition", "flow", "balance", "center", "ground", "lift", "open", "close"]
CLIP_INSTRUCTION = ["now", "next", "here", "let's", "we're going to", "take a", "bring your", "find your", "notice"]
CLIP_ADDRESS = ["you", "your", "we", "us", "let's"]
CLIP_BREATH = ["breathe", "inhale", "exhale", "breath"]
CLIP_MOVEMENT = ["move", "shift", "come", "go", "bring", "take", "lift", "lower"]

#: Rules of a clip's content type: (label, words); the first that holds decides. The first three are within POSE.
POSE = ["pose", "asana", "position", "stretch", "yoga"]
CLIP_TYPES = {
    "movement": ["move", "shift", "come into", "step", "walk"],
    "breathing": ["breathe", "breath", "inhale", "exhale", "mindful"],
    "educational": ["learn", "teach", "explain", "how to", "tutorial"],
    "interactive": ["feel", "notice", "you", "your"],
    "motivational": ["motivate", "inspire", "success", "achieve", "believe"],
    "introduction": ["welcome", "hello", "hi", "today", "begin"],
    "conclusion": ["thank", "thanks", "end", "finish", "complete", "namaste"],
}

SPEECH_TYPES = {
    "question": ["what", "why", "how", "when", "where", "who"],
    "instruction": ["let", "make", "do", "try", "follow", "step"],
    "explanation": ["because", "since", "therefore", "so", "explain", "reason"],
    "narrative": ["once", "then", "after", "before", "story", "happened"],
    "opinion": ["think", "believe", "feel", "opinion", "personally"],
}
ZOOM = {
    "close_up": ["important", "key", "focus", "listen", "crucial", "essential", "remember", "note", "pay attention", "highlight", "emphasis", "secret", "confidential", "personal", "intimate"],
    "wide_shot": ["everyone", "all", "group", "together", "audience", "crowd", "team", "community", "collective", "whole", "entire", "overview", "general", "broad", "context"],
    "medium_shot": ["explain", "describe", "discuss", "talk about", "conversation", "dialogue", "presentation", "interview", "normal", "regular"],
    "dynamic": ["move", "show", "demonstrate", "look", "point", "gesture", "action", "activity", "performance", "dance", "exercise"],
}
EMOTION = {
    "high": ["amazing", "incredible", "wow", "fantastic", "awesome", "terrible", "horrible", "disaster", "crisis", "emergency", "excited", "thrilled", "shocked", "surprised", "angry", "furious", "love", "hate", "breakthrough", "revolutionary"],
    "medium": ["good", "bad", "nice", "interesting", "cool", "strange", "weird", "happy", "sad", "concerned", "worried", "pleased", "disappointed", "satisfied", "frustrated"],
    "low": ["okay", "fine", "normal", "regular", "standard", "typical", "usual", "common", "average", "moderate", "calm", "peaceful"],
}
#: Whole words, not parts of words.
EMPHASIS_TOKENS = ["very", "really", "extremely", "absolutely", "definitely", "certainly", "surely", "indeed", "particularly", "especially"]
ACTION_TOKENS = ["move", "go", "come", "run", "walk", "jump", "dance", "perform", "show", "point", "gesture", "demonstrate", "present", "display", "look", "see", "watch", "observe", "examine", "check", "turn", "rotate", "spin", "flip", "slide", "push", "pull"]
KEY_TOKENS = ["important", "key", "crucial", "significant", "essential", "remember", "notice", "look", "see", "watch", "focus", "amazing", "incredible", "fantastic", "wow", "great"]
ENGAGEMENT_TOKENS = ["amazing", "incredible", "important", "key", "essential", "crucial"]
EMOTION_TOKENS = ["love", "hate", "excited", "amazing", "terrible", "wonderful"]
FILLER_TOKENS = ["um", "uh", "like", "you know", "basically", "actually"]

PERSONAL = ["i", "you", "we", "let me", "look at", "see this"]
GROUP = ["everyone", "all", "group", "together"]
MUSIC = ["[music]", "♪", "♫", "[instrumental]", "[intro music]", "music playing", "instrumental", "theme music", "background music"]
INTRO = ["welcome to", "hello everyone", "hi everyone", "hey guys", "welcome back", "in this video", "today we're going to", "before we start", "let me introduce", "this is", "my name is"]

VIRAL = ["amazing", "incredible", "unbelievable", "shocking", "mind-blowing", "secret", "trick", "hack", "tip", "mistake", "fail", "win", "before", "after", "transformation", "reveal", "exposed"]
HOOKS = ["you won't believe", "this will shock you", "wait for it", "watch this", "this is crazy", "you need to see this", "here's why", "the truth about", "what happens next"]
ACTIONS = ["discover", "learn", "find", "get", "achieve", "master", "unlock"]
FEELINGS = ["amazing", "incredible", "awesome", "fantastic", "brilliant", "terrible", "awful", "horrible", "disaster", "worst", "shocking", "unbelievable", "unexpected", "surprising", "now", "immediately", "urgent", "quick", "fast"]
URGENCY = ["now", "today", "immediately", "urgent", "limited time", "hurry"]
SOCIAL_PROOF = ["everyone", "millions", "thousands", "proven", "tested", "verified"]
CATEGORIES = {
    "educational": ["learn", "tutorial", "how to", "explain", "understand", "guide"],
    "entertainment": ["funny", "hilarious", "comedy", "joke", "laugh"],
    "motivational": ["success", "achieve", "inspire", "motivation", "goals", "dream"],
    "lifestyle": ["daily", "routine", "life", "personal", "experience", "tips"],
    "tech": ["technology", "app", "software", "digital", "online", "internet"],
    "business": ["money", "business", "entrepreneur", "profit", "sales", "marketing"],
}
AUDIENCES = {
    "students": ["college", "university", "student", "study"],
    "professionals": ["business", "professional", "career", "work"],
    "creators": ["creator", "content", "youtube", "tiktok"],
}
CATEGORY_AUDIENCE = {"educational": "students", "business": "professionals", "lifestyle": "young_adults", "tech": "young_adults", "entertainment": "general"}
#: Weights of viral potential and optimisation score.
PLATFORMS = {"tiktok": (0.4, 0.6), "youtube_shorts": (0.3, 0.7), "instagram": (0.35, 0.65)}

INTENSITY_VOLUME = ["!", "?", "loud", "shout", "yell", "scream", "whisper"]
INTENSITY_EMOTION = ["amazing", "incredible", "shocking", "stunning", "unbelievable", "dramatic", "intense", "powerful", "overwhelming", "breathtaking"]

#: Themes: words, feelings, and phrases of which any word counts.
THEMES = {
    "climax": (["climax", "peak", "highest point", "crucial moment", "turning point"], ["excitement", "tension", "drama", "intensity"], ["increased volume", "rapid speech", "emphasis", "passion"]),
    "comedy": (["funny", "humor", "joke", "laugh", "amusing", "hilarious"], ["joy", "amusement", "laughter", "playfulness"], ["laughter", "funny voices", "comedic timing", "punchlines"]),
    "emotional": (["emotional", "touching", "heartfelt", "moving", "inspiring"], ["sadness", "joy", "inspiration", "empathy", "connection"], ["soft speech", "emotional tone", "pauses", "sincerity"]),
    "educational": (["learn", "explain", "tutorial", "how to", "educational"], ["clarity", "understanding", "curiosity", "enlightenment"], ["clear speech", "explanatory tone", "structured delivery"]),
    "action": (["action", "fast", "dynamic", "movement", "energy", "exciting"], ["excitement", "adrenaline", "intensity", "energy"], ["fast speech", "dynamic audio", "sound effects", "music"]),
    "motivational": (["motivational", "inspiring", "uplifting", "positive", "encourage"], ["inspiration", "hope", "determination", "positivity"], ["passionate delivery", "crescendo", "emphasis", "conviction"]),
    "general": (["engagement", "interesting", "captivating", "attention"], ["interest", "curiosity", "engagement", "attention"], ["varied tone", "clear delivery", "engaging pace"]),
}

CONTINUATION = ["and", "but", "so", "because", "however", "also", "then", "therefore", "moreover", "furthermore", "although", "though", "yet", "still", "besides", "meanwhile", "otherwise", "hence"]
OPENERS = ["what", "why", "how", "when", "where", "who", "which", "the", "this", "there", "here", "now", "today", "imagine", "let", "think", "consider", "remember", "look", "see", "first", "one", "i", "we", "you", "if", "every", "all"]
QUESTION_WORDS = ["what", "why", "how", "when", "where", "who"]
CLOSING = ["thank", "thanks", "finally", "conclusion", "summary", "remember"]
INCOMPLETE = r"\b(and|but|or|so|because|if|when|while|as|that|which)\s*$|\bthe\s*$|\bto\s*$|\ba\s*$|\bin\s*$|\bof\s*$|,\s*$"
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "is", "it", "of", "that", "this"]

CREDITS = ["credits", "directed by", "produced by", "executive producer", "written by", "screenplay by", "music by", "cinematography", "editing by", "cast", "starring", "featuring", "special thanks", "acknowledgments", "copyright", "©", "all rights reserved", "soundtrack", "original music", "theme song", "end credits", "closing credits", "rolling credits", "courtesy of", "licensed", "warner bros", "universal pictures", "paramount", "disney", "columbia pictures", "twentieth century", "mgm", "studio"]

#: Categories of the diverse selection, in their order.
DIVERSITY = {
    "instruction": ["how", "let's", "we're going to", "now", "next"],
    "demonstration": ["breathe", "inhale", "exhale", "hold", "stretch"],
    "transition": ["move", "shift", "transition", "come into", "step"],
    "interactive": ["you", "feel", "notice"],
    "high_energy": ["jump", "quick", "fast", "energy", "power", "strong"],
    "calm": ["relax", "gentle", "soft", "peaceful", "calm", "rest", "slow"],
}

#: Requests for a climax: whole phrases count 1, phrases of which only a word of over four letters occurs 0.3, clues 0.5.
CLIMAX = ["climax", "peak", "apex", "zenith", "pinnacle", "summit", "crescendo", "high point", "turning point", "crucial moment", "pivotal moment", "decisive moment", "critical point", "breaking point", "tipping point", "dramatic scenes", "intense scenes", "powerful scenes", "gripping scenes", "thrilling scenes", "electrifying scenes", "breathtaking scenes", "explosive scenes", "spectacular scenes", "mind-blowing scenes", "best dramatic scenes", "most important scenes", "essential dramatic scenes", "defining dramatic moments", "iconic dramatic scenes", "emotional peaks", "most emotional scenes", "emotional climax", "action-packed scenes", "most exciting action", "intense action scenes", "thrilling action sequences", "finale", "ending climax", "dramatic conclusion", "dramatic resolution", "showdown", "confrontation", "face-off", "final battle", "ultimate dramatic moment"]
CLIMAX_CLUES = ["from the movie climax", "from the film climax", "dramatic part of", "most dramatic", "most intense", "most gripping"]
NOT_CLIMAX = ["comedy", "funny", "humor", "humorous", "joke", "laugh", "amusing", "hilarious", "educational", "learn", "tutorial", "teach", "explain", "instructional"]
NOT_CLIMAX_UNLESS_PEAK = ["emotional", "touching", "moving", "heartfelt", "sentimental"]
COMEDY_WORDS = ["comedy", "funny", "humor", "humorous", "joke", "jokes", "laugh", "laughter", "amusing", "hilarious", "witty", "entertaining", "comedic", "comic", "light-hearted", "light hearted", "playful", "silly", "goofy"]
COMEDY_PHRASES = ["comedy moments", "funny moments", "funny scenes", "comedy scenes", "humorous parts", "amusing parts", "entertaining moments", "laugh out loud", "make me laugh", "something funny"]
INTENTS = {
    "climax": ["climax", "peak", "intense", "dramatic", "tension", "exciting", "thrilling"],
    "comedy": ["funny", "humor", "laugh", "joke", "amusing", "entertaining", "hilarious"],
    "educational": ["learn", "teach", "explain", "instruction", "tutorial", "guide", "how"],
    "emotional": ["emotion", "feel", "touching", "moving", "heartfelt", "inspiring"],
    "action": ["action", "fast", "quick", "dynamic", "movement", "energy"],
    "highlights": ["best", "important", "key", "main", "crucial", "significant"],
    "summary": ["summary", "overview", "recap", "conclusion", "points"],
}
COMPONENTS = ["battery", "display", "screen", "panel", "camera", "sensor", "lens", "chip", "chipset", "processor", "cpu", "gpu", "ram", "storage", "charge", "charging", "fast charge", "wireless charging", "brightness", "nits", "refresh", "frame rate", "speaker", "audio", "mic", "microphone", "stabilization", "ois", "eis", "dynamic range", "hdr", "amoled", "oled", "lcd", "mini led"]
HIGH_REFRESH = ["high refresh", "higher refresh", "fast refresh", "smooth display", "120 fps", "high fps", "buttery smooth"]
FOCUS_STOP = ["the", "and", "with", "that", "this", "what", "when", "your", "you", "for", "from", "video", "clip", "short"]

CATEGORY_TAGS = {
    "educational": ["learn", "tutorial", "education", "howto", "tips"],
    "entertainment": ["funny", "comedy", "entertainment", "viral", "trending"],
    "motivational": ["motivation", "inspiration", "success", "mindset", "goals"],
    "lifestyle": ["lifestyle", "daily", "personal", "life", "routine"],
    "tech": ["tech", "technology", "digital", "innovation", "gadgets"],
    "business": ["business", "entrepreneur", "money", "success", "marketing"],
}
TITLE_PATTERNS = {"educational": "How to %s", "entertainment": "This is hilarious %s", "motivational": "How %s changed my life", "lifestyle": "My %s routine"}
PHRASE_ACTIONS = ["learn", "discover", "find", "get", "achieve"]
HIGHLIGHT_EMOTIONS = ["amazing", "incredible", "shocking", "unbelievable"]
