"""Word lists that results depend on, as plain text."""

STOP_WORDS = (
    "i me my we our ours you your yours he him his she her hers it its they them their theirs what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing a an the and but if "
    "or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: Phrases of pages that are not articles (fixed values).
BOILERPLATE = (
    "This Account has been suspended",
    "Not Found The requested URL",
    "Tap here to turn on desktop notification",
    "This website uses cookie",
    "Please Sign In and use",
    "Log in to access content",
    "External links are provided for reference purposes",
    "Page not found",
    "Here are some suggestions for finding",
    "Some Word features can't be displayed",
    "Small (S) has the shortest download time",
    "Permission (Reusing this file)",
    "browser must have JavaScript",
    "Log In Logging in for the first time",
    "404 - Page Not Found",
    "404 Error",
    "You are free: to share",
    "Copyright. All Rights Reserved",
    "Some older articles might not yet have been migrated",
    "Please enable Cookies on your browser",
    "Enter your first name: Enter your last name:",
    "Need Help? Chat Now",
    "Close Get email notifications",
    "Comp licence:",
    "Donations are welcome at the time of your visit",
    "Image searched for: You've reached your daily search limit",
    "Read, highlight, and take notes, across web, tablet, and phone",
    "Send me email updates and offers from Fox",
    "I, the copyright holder of this work, hereby publish it under the following license",
    "Just One More Thing... We have sent you a verification email.",
    "Please upgrade your browser",
    "Tor Tor is an encrypted anonymising network that makes it harder",
    "Note: Javascript is disabled",
    "LII has no control over and does not endorse any",
    "TinEye is an image search and recognition company",
    "search textbox has an autosuggest feature",
    "interactive transcript could not be loaded",
    "Page Not Found",
)

#: Hosts whose pages are not news articles, by part of the URL (fixed values).
NOT_NEWS = ("twitter", "facebook", "youtu.be", "youtube", "reddit", "flickr", "wikisource")
#: Parts of URLs that are not pages (fixed values).
MEDIA = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".tif", ".tiff", ".jif", "jfif", ".jpx", ".mp3", ".mp4")
#: Some public suffixes, where no whole table of them is at hand.
SUFFIXES = ("com", "net", "org", "edu", "gov", "info", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "au", "com.au", "jp", "co.jp", "*.ck", "!www.ck")
#: Fact-checking sites, by part of the URL (fixed values).
DEBUNKERS = ("snope", "politifact")

#: Lexicons by name: small lists of our own; ``sources.lexicons`` loads others from a folder.
LEXICONS = {
    "hedges": "may might could perhaps possibly probably seem seems suggest about almost of".split(),
    "assertives": "say says said claim claims state report argue that this".split(),
    "factives": "know knows realize regret discover with from".split(),
    "modals": "must shall would should can will is are".split(),
}

#: Universal part-of-speech tags by word; other words are tagged by their endings.
TAG_WORDS = {
    "DET": "the a an this that these those".split(),
    "ADP": "of in on at by for with from to into".split(),
    "CONJ": "and or but".split(),
    "PRON": "i you he she it we they".split(),
    "VERB": "is are was were be been have has had".split(),
}
TAG_ENDINGS = (("ly", "ADV"), ("ing", "VERB"), ("ed", "VERB"), ("able", "ADJ"), ("ble", "ADJ"), ("tion", "NOUN"))
TAGS = ("ADJ", "ADP", "ADV", "CONJ", "DET", "NOUN", "NUM", "PRON", "VERB", "X", ".", "PRT")
