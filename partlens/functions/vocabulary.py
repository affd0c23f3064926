"""The word lists, patterns and weights that decide results, in the order in which they are tried."""

COMPONENTS = {
    "CROWN": ["crown", "krone"],
    "LINK": ["link", "glied", "ersatzglied", "bandglied", "bracelet", "band", "strap"],
    "DIAL": ["dial", "zifferblatt"],
    "WHEEL": ["wheel", "rad", "umkehrrad", "stundenrad", "kronrad", "ankerrad", "minutenrad", "sperrrad"],
    "CRYSTAL": ["crystal", "saphirglas", "glas", "sapphire", "plexiglas", "uhrenglas"],
    "BEZEL": ["bezel", "lünette"],
    "SPRING": ["spring", "mainspring", "feder", "zugfeder", "hauptfeder"],
    "BALANCE": ["balance", "unruh", "unruhwelle"],
    "TUBE": ["tube", "tubus"],
    "HANDS": ["zeiger", "hands", "hand"],
    "LEVER": ["lever", "anker", "pallet", "fork", "winkelhebel", "hebel"],
    "SCREW": ["screw", "schraube"],
    "CLASP": ["clasp", "faltschliesse", "dornschliesse"],
    "ROTOR": ["rotor", "schwungmasse"],
    "BRIDGE": ["bridge", "brücke"],
    "BARREL": ["barrel", "federhaus"],
    "CASE": ["case", "gehäuse"],
    "RATCHET": ["ratchet", "click", "klinke"],
    "ARBOR": ["arbor", "staff", "achse", "trieb"],
    "STEM": ["stem", "welle"],
    "GASKET": ["gasket", "dichtung"],
    "PUSHER": ["pusher", "drücker"],
    "JEWEL": ["jewel", "stein", "deckstein", "lochstein"],
    "PLATE": ["plate", "platte"],
}
BRANDS = ["rolex", "tudor"]
COMPETITORS = ["omega", "seiko", "citizen", "patek", "audemars", "vacheron", "jaeger", "lecoultre", "iwc", "panerai", "cartier", "breitling", "tag heuer", "heuer", "longines", "tissot", "hamilton", "zenith", "hublot", "montblanc", "bulova", "eterna", "movado", "sinn", "oris", "rado"]
DOCUMENTATION = ["manual", "anleitung", "bedienungsanleitung", "gebrauchsanweisung", "booklet", "instruction", "instructions", "catalog", "catalogue", "katalog", "brochure", "prospekt", "papiere", "zertifikat", "certificate", "warranty card", r"\bpapers\b", r"\bbook\b", r"\bbuch\b", r"\bheft\b"]
LINK_OR_CLASP = [r"\blink\b", r"\bclasp\b", r"\bschließe\b", r"\bdornschließe\b", "ersatzglied"]
ACCESSORY = [r"\bbox\b", "boxes", "karton", "etui", "pouch", "tasche", r"\bstrap\b", r"\barmband\b", "bracelet", "buckle", "dornschließe", "schließe", "display", r"\bstand\b", r"\bständer\b", "winder", "uhrenbeweger", r"\btool\b", "werkzeug", "loupe", r"\blupe\b", "watch box", "case only", "nur gehäuse"]
SPARE_PART = ["ersatzteil", "ersatzteile", r"\bersatz\b", "spare part", "spare parts", "for parts", "parts only", r"\bteile\b", r"\bteil\b", "konvolut", "bastler", "for repair", "zur reparatur", "as is", "defekt"]
COMPLETE_WATCH = ["armbanduhr", "wristwatch", "wrist watch", "taschenuhr", "pocket watch", "complete watch", "full watch", "whole watch", "komplette uhr", "komplette armbanduhr", "running watch", r"\buhr komplett\b", "herrenuhr", "damenuhr"]
STRONG_COMPONENT = ["movement", "uhrwerk", r"\bwerk\b", "mainspring", "zugfeder", "balance spring", "hairspring", "unruh", r"\bstem\b", "aufzugswelle", "aufzugwelle", "setting lever", "wheel", r"\bbarrel\b", r"\bbridge\b", r"\brotor\b", "gear"]
WATCH_PART = [
    r"\bpart\b", r"\bparts\b", "wheel", r"\bscrew\b", "mainspring", "hairspring", r"\bspring\b", r"\bbalance\b", r"\bbridge\b", r"\bstem\b", r"\bstaff\b", r"\bjewel\b", "pinion", "setting lever", r"\bclick\b", "ratchet", r"\brotor\b", r"\bbarrel\b", "crown wheel", "escape wheel", r"\bpallet\b", r"\bdial\b", r"\bhand\b", r"\bhands\b", "movement", r"\bcaliber\b", r"\bcalibre\b", r"\bcannon pinion\b", "keyless", r"\bgasket\b", r"\bcrown\b", r"\bbezel\b", r"\bplate\b", r"\bcock\b", "mainplate",
    r"\brad\b", "ankerrad", "sekundenrad", "minutenrad", "schraube", r"\bfeder\b", "zugfeder", "spirale", "unruh", "unruhwelle", "brücke", "bruecke", r"\bwelle\b", "aufzugswelle", r"\bstein\b", "lagerstein", r"\btrieb\b", "sperrad", "klinke", "federhaus", "zeiger", "zifferblatt", r"\banker\b", "uhrwerk", r"\bwerk\b", r"\bkrone\b", "aufzug", "buchse", "lünette", "luenette", "zapfen", "platine", r"\bkloben\b", "kaliber", r"\bkal\b", r"\bcal\b",
]
NEGATIVE = ["compatible", "replacement", "for", "style", "alternative", "homage", "similar", "bundle", "lot", "generic", "aftermarket", "fits"]
LOT = r"\b\d+\s*x\b|\bbundle\b|\bjob\s*lot\b|\bkonvolut\b|\bsammlung\b|\blot\s+of\b|\bx\s*rolex\b"
COMPATIBLE = r"\b(?:fits?|for|compatible|passend\s*f(?:ü|u)r|kompatibel)\b"
REFERENCE_LIST = r"\d{4,6}(?:\s*[/,]\s*\d{4,6}){2,}"
CALIBRE_LIST = r"\b(?:cal\.?|calibre|caliber|kaliber|calib)\s*:?\s*(\d{2,4}(?:\s*[,/]\s*\d{2,4}){1,})"
CALIBRE_LABEL = r"\b(?:cal\.?|calibre|caliber|kaliber)\s*:?\s*(\d{2,4})\b"
WHOLE_WATCH = r"\b(?:complete\s+watch|full\s+watch|wristwatch|komplette\s+uhr|ganze\s+uhr)\b"
#: Names of watch models, of which a number may follow ("explorer 2").
MODEL_WORDS = ["explorer", "submariner", "gmt", "master", "daytona", "datejust", "milgauss", "yacht-master", "yachtmaster", "sea-dweller", "seadweller", "day-date", "daydate", "oysterdate", "cosmograph", "turnograph"]
