"""Patterns, word lists, weights and tables that right results depend on.

All patterns are for case-insensitive search in text whose non-ASCII characters have been replaced by one
filler each (see ``text.ascii_fold``), unless said otherwise where they are used.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    category: str
    reason: str
    weight: int
    confidence: str
    fields: str  # allText, title, or title+priceText
    pattern: str


class Toggle(NamedTuple):
    id: str
    kind: str  # vendor: off / filter / block; binary: off / filter
    label: str
    rule_ids: tuple[str, ...]


# ---- fixed values: static rules, in the order in which they apply ----
RULES: list[Rule] = [
    Rule("vendor-temu", "known-vendor", "Temu/source mention", 32, "high", "allText",
         r"\btemu\b"),
    Rule("vendor-aliexpress", "known-vendor", "AliExpress/source mention", 32, "high", "allText",
         r"\bali\s*express\b"),
    Rule("vendor-alibaba", "known-vendor", "Alibaba/source mention", 32, "high", "allText",
         r"\balibaba\b"),
    Rule("vendor-dhgate", "known-vendor", "DHgate/source mention", 32, "high", "allText",
         r"\bdhgate\b"),
    Rule("vendor-banggood", "known-vendor", "Banggood/source mention", 32, "high", "allText",
         r"\bbanggood\b"),
    Rule("vendor-shein", "known-vendor", "SHEIN/source mention", 30, "high", "allText",
         r"\bshein\b"),
    Rule("vendor-tiktok-shop", "known-vendor", "TikTok Shop/source mention", 30, "high", "allText",
         r"\btiktok\s*shop\b"),
    Rule("vendor-wish", "known-vendor", "Wish marketplace mention", 30, "high", "allText",
         r"\bwish\.com\b|\bwish\s+app\b|\b(?:from|off|on|via)\s+wish\b|\bordered\s+(?:from|on)\s+wish\b"),
    Rule("vendor-shopify", "known-vendor", "Shopify storefront mention", 26, "medium", "allText",
         r"\bshopify\b"),
    Rule("vendor-amazon", "known-vendor", "Amazon/source mention", 22, "medium", "allText",
         r"\bamazon\b(?!\s*(?:echo|alexa|kindle|fire|firestick|dot|show|tap|halo|eero|basics|music|prime))"),
    Rule("vendor-ikea", "known-vendor", "IKEA mention", 14, "low", "allText",
         r"\bikea\b"),
    Rule("vendor-wayfair", "known-vendor", "Wayfair mention", 16, "low", "allText",
         r"\bwayfair\b"),
    Rule("vendor-overstock", "known-vendor", "Overstock mention", 16, "low", "allText",
         r"\boverstock\b"),
    Rule("vendor-walmart", "known-vendor", "Walmart mention", 14, "low", "allText",
         r"\bwalmart\b"),
    Rule("vendor-target", "known-vendor", "Target store mention", 14, "low", "allText",
         r"\b(?:from|at|bought\s+at)\s+target\b|\btarget\s+(?:brand|clearance|exclusive)\b"),
    Rule("vendor-costco", "known-vendor", "Costco mention", 14, "low", "allText",
         r"\bcostco\b"),
    Rule("vendor-sams-club", "known-vendor", "Sam's Club mention", 14, "low", "allText",
         r"\bsam'?s\s+club\b"),
    Rule("vendor-home-depot", "known-vendor", "Home Depot mention", 14, "low", "allText",
         r"\bhome\s*depot\b"),
    Rule("vendor-lowes", "known-vendor", "Lowe's mention", 14, "low", "allText",
         r"\blowe'?s\b"),
    Rule("vendor-ashley", "known-vendor", "Ashley Furniture mention", 16, "low", "allText",
         r"\bashley\s+furniture\b"),
    Rule("vendor-rooms-to-go", "known-vendor", "Rooms To Go mention", 16, "low", "allText",
         r"\brooms?\s+to\s+go\b"),
    Rule("vendor-ebay", "known-vendor", "eBay mention", 12, "low", "allText",
         r"\be\s*bay\b|\bebay\b"),
    Rule("vendor-mercari", "known-vendor", "Mercari mention", 12, "low", "allText",
         r"\bmercari\b"),
    Rule("vendor-poshmark", "known-vendor", "Poshmark mention", 12, "low", "allText",
         r"\bposhmark\b"),
    Rule("vendor-copycat-language", "counterfeit", "replica/copycat language", 54, "high", "allText",
         r"\b(?:replica|knock[-\s]?off|counterfeit|fake\s+(?:designer|luxury|brand)|bootleg|superclone|super\s+clone|1\s*:\s*1(?!\s*scale)|aaa\s+(?:quality|replica|grade)|mirror\s+(?:quality|grade|copy)|unauthorized\s+authentic|ua\s+(?:pair|quality|batch|shoes|sneakers)|best\s+batch|rep\s+(?:pair|shoes|sneakers)|not\s+authentic)\b"),
    Rule("counterfeit-designer-dupe", "counterfeit", "designer-dupe language", 38, "medium", "allText",
         r"\b(?:designer\s+dupe|dupe\s+(?:bag|shoes|sneakers|watch)|(?:designer|luxury|brand)[-\s]inspired|inspired\s+by\s+(?:lv|louis\s+vuitton|gucci|chanel|prada|dior|herm[eè]s)|look\s*alike\s+(?:bag|watch|shoes)|same\s+as\s+(?:the\s+)?(?:real|authentic|original)\s+(?:one|thing)|luxury\s+inspired)\b"),
    Rule("dropship-variants", "dropship-phrasing", "variant/catalog availability", 30, "high", "allText",
         r"\b(?:available\s+in\s+(?:multiple|many|different|all)\s+(?:colors?|colours?|sizes?)|multiple\s+(?:colors?|colours?|sizes?)\s+available|choose\s+(?:your\s+)?(?:colors?|colours?|sizes?)\b|all\s+sizes?\s+available|any\s+size\s+available|customize\s+your\s+order|made\s+to\s+order)\b"),
    Rule("dropship-order-language", "dropship-phrasing", "order fulfillment language", 32, "high", "allText",
         r"\b(?:order\s+(?:now|today|yours)|dm\s+(?:me\s+)?to\s+order|message\s+(?:me\s+)?to\s+order|place\s+(?:an\s+|your\s+)?order|order\s+(?:through|via)\b|ships?\s+(?:direct|nationwide)|ships?\s+from\s+(?:our\s+)?(?:warehouse|supplier|factory)|delivery\s+nationwide|limited\s+stock|while\s+supplies\s+last)\b"),
    Rule("dropship-wholesale", "dropship-phrasing", "wholesale/supplier language", 34, "high", "allText",
         r"\b(?:wholesale|bulk\s+(?:available|pricing|orders?)|supplier|factory\s+direct|imported\s+direct|warehouse\s+stock|new\s+inventory|reseller\s+pricing)\b"),
    Rule("new-in-box-title", "dropship-phrasing", "brand-new/in-box resale item", 34, "medium", "title",
         r"\b(?:brand[\s-]?new|bnib|(?<!gold\s)(?<!steel\s)(?<!fine\s)(?<!medium\s)(?<!broad\s)(?<!italic\s)(?<!stub\s)nib\b(?!\s*(?:size|width|section|unit))|new\s*,?\s+in\s+(?:the\s+)?box|still\s+(?:in|sealed\s+in)\s+(?:the\s+)?(?:box|plastic|packaging|wrapper)|never\s+(?:used|opened|worn))\b"),
    Rule("shop-catalog-product", "dropship-phrasing", "shop catalog product card", 44, "high", "allText",
         r"\b(?:view\s+in\s+3d|see\s+it\s+in\s+your\s+space|choose\s+(?:a\s+)?(?:color|colour|finish|fabric)\s*:)\b"),
    Rule("dropship-quantity", "dropship-phrasing", "quantity-on-hand language", 16, "low", "allText",
         r"\b(?:multiple\s+(?:available|units|in\s+stock)|many\s+available|more\s+in\s+stock|restocked)\b"),
    Rule("store-showroom", "store-business", "store or showroom ad", 40, "high", "allText",
         r"\b(?:showroom|(?<!no\s)(?<!not\s+a\s)(?<!not\s)dealer(?!\s+plates?|\s+fees?)|dealership|retail\s+store|store\s+hours|visit\s+(?:us|our\s+(?:store|location|website))|grand\s+opening)\b"),
    Rule("store-liquidation-outlet", "store-business", "liquidation/outlet listing", 30, "medium", "allText",
         r"\b(?:warehouse\s+sale|liquidation|pallets?\s+(?:sale|available|of)|(?:amazon|store)\s+returns?\s+pallets?|truckloads?\s+(?:sale|available)|outlet\s+(?:store|prices?|deals?|mall)|furniture\s+outlet|mystery\s+box(?:es)?)\b"),
    Rule("store-sales-language", "store-business", "commercial sales language", 26, "medium", "allText",
         r"\b(?:inventory|in\s+stock|tax\s+(?:included|extra)|plus\s+(?:hst|gst)\b|financing\s+available|lease\s+to\s+own|rent\s+to\s+own|new\s+shipment|weekly\s+specials?|ask\s+about\s+financing|90\s+days?\s+same\s+as\s+cash)\b|\+\s*(?:hst|gst)\b"),
    Rule("store-call-to-action", "store-business", "business call to action", 28, "medium", "allText",
         r"\b(?:call\s+today|text\s+.{0,24}to\s+(?:buy|order|purchase)|contact\s+our\s+team|apply\s+(?:today|now)|schedule\s+a\s+(?:showing|visit|test\s+drive)|book\s+now|check\s+out\s+our\s+(?:page|website|store))\b"),
    Rule("store-auto-dealer-financing", "store-business", "auto dealer financing", 44, "high", "allText",
         r"\b(?:buy\s+here\s+pay\s+here|we\s+finance|in[-\s]?house\s+financing|bad\s+credit(?:\s*[,.?!]?\s*no\s+credit)?|no\s+credit\s+(?:ok|okay|approved|needed|check)|everyone\s+(?:is\s+)?approved|all\s+credit\s+(?:welcome|accepted|ok)|get\s+(?:you\s+)?approved|guaranteed\s+approval|payments?\s+as\s+low\s+as|drives?\s+(?:it\s+)?(?:home\s+)?today|low\s+down\s+payment|cash\s+down|down\s+payment\s+(?:required|as\s+low\s+as)|o\.?a\.?c\.?\b|w\.?a\.?c\.?\b)\b|\$\d+\s+down\b"),
    Rule("store-auto-dealer-fees", "store-business", "dealer fee language", 34, "medium", "allText",
         r"\b(?:plus\s+(?:tax|ttl|title|license|licensing|registration|doc\s+fee|dealer\s+fee)|tax\s+title\s+(?:and\s+)?license|title\s+and\s+license\s+fees|dmv\s+fees?|doc\s+fees?|(?<!no\s)(?<!or\s)(?<!zero\s)(?<!without\s)dealer\s+fees?|safety\s+certification\s+(?:available|extra))\b|\+\s*(?:ttl|licensing|doc\s+fee)\b"),
    Rule("external-url", "external-redirect", "external website/order link", 46, "high", "allText",
         r"(?:https?://|\bwww\.[a-z0-9-]+|bit\.ly|tinyurl|linktr\.ee|goo\.gl|\.shop\b|\.store\b|link\s+in\s+(?:bio|profile|comments?)|order\s+(?:at|on|from)\s+[a-z0-9-]+\.(?:com|net|ca|shop|store))"),
    Rule("external-bare-domain", "external-redirect", "website mention", 22, "low", "allText",
         r"\b[a-z0-9-]{3,}\.(?:com|net)\b"),
    Rule("external-retailer-product-link", "external-redirect", "retailer catalog/product link", 40, "high", "allText",
         r"\b(?:wayfair|amazon|walmart|target|ikea|overstock|temu|aliexpress|dhgate|shein|homedepot|lowe'?s|costco|bestbuy|samsclub|alibaba|banggood|wish)\.(?:com|ca|co\.uk|net)\S*(?:/pdp/|/dp/|/ip/|/itm/|/gp/product|/p/[a-z0-9-]|/product[s/-]|[?&](?:piid|skuid|pid|asin|item)=)"),
    Rule("external-messaging", "external-redirect", "off-platform messaging app", 24, "medium", "allText",
         r"\b(?:whats\s*app|telegram)\b"),
    Rule("external-promo-code", "external-redirect", "promo/checkout language", 30, "medium", "allText",
         r"\b(?:coupon\s+code|promo\s+code|discount\s+code|use\s+code\s+\w+|checkout|add\s+to\s+cart|online\s+only)\b"),
    Rule("external-phone-number", "external-redirect", "phone-number contact", 16, "low", "allText",
         r"\b(?:call|text|txt|sms)\b.{0,36}(?:\+?1[\s.-]?)?(?:\(?[2-9]\d{2}\)?[\s.-]?[2-9]\d{2}[\s.-]?\d{4})\b"),
    Rule("external-social-handle", "external-redirect", "social-handle redirect", 26, "medium", "allText",
         r"\b(?:instagram|insta|ig|tiktok|snap(?:chat)?)\b.{0,24}@[a-z0-9_.]{3,}|@[a-z0-9_.]{3,}\s+(?:on|to)\s+(?:instagram|insta|ig|tiktok)|follow\s+(?:my|our)\s+(?:page|store|shop)"),
    Rule("not-for-sale-title-request", "not-for-sale", "wanted/request post", 74, "high", "title",
         r"\b(?:iso|wtb|in\s+search\s+of|looking\s+(?:for(?!\s+(?:a\s+|its\s+|their\s+)?(?:new|good|forever)\s+home)|to\s+buy)|want(?:ed)?\s+to\s+buy|seeking(?!\s+(?:a\s+)?(?:new|good)\s+home))\b|^wanted\b(?!\s*(?:movie|film|poster|dvd|vhs|sign|print|dead\s+or\s+alive))|\bwanted:\s"),
    Rule("not-for-sale-request-language", "not-for-sale", "wanted/request post", 72, "high", "allText",
         r"\b(?:does\s+anyone\s+have|anyone\s+(?:have|selling|got)\s+(?:a|an|any)\b|looking\s+to\s+buy|want(?:ed)?\s+to\s+buy|in\s+search\s+of|wtb)\b"),
    Rule("not-for-sale-trade-only", "not-for-sale", "trade/barter post", 72, "medium", "allText",
         r"\b(?:trade\s+only|trades?\s+only|not\s+selling[,.]?\s+trades?|looking\s+to\s+trade|will\s+(?:only\s+)?trade\s+for|swap\s+for|barter)\b"),
    Rule("not-for-sale-unavailable", "not-for-sale", "sold/pending listing", 74, "high", "title+priceText",
         r"\b(?:sold(?!\s+(?:separately|individually|as\s+(?:a\s+)?(?:set|pair|lot)|together))|pending(?:\s+pickup)?|reserved|on\s+hold)\b"),
    Rule("service-moving-hauling", "service-spam", "moving/hauling service ad", 46, "high", "allText",
         r"\b(?:junk\s+removal|we\s+haul|haul\s+(?:away|it\s+all)|hauling\s+services?|moving\s+services?|movers\b|cleanouts?\b|dump\s+runs?|demolition|labor\s+available|two\s+men\s+and)\b"),
    Rule("service-home-contractor", "service-spam", "contractor/service ad", 42, "high", "allText",
         r"\b(?:free\s+estimates?|licensed\s+(?:and|&)\s+insured|fully\s+insured|we\s+(?:install|repair|come\s+to\s+you)|installation\s+(?:services?|available|included)|repair\s+services?|handyman|lawn\s+care|snow\s+removal|pressure\s+washing|house\s+cleaning|cleaning\s+services?|tree\s+(?:service|removal|trimming)|credit\s+repair|tax\s+prep(?:aration)?|notary\s+services?|mobile\s+(?:detailing|mechanic))\b"),
    Rule("service-rentals-real-estate", "service-spam", "rental or real-estate ad", 46, "high", "allText",
         r"\b(?:(?:apartment|room|house|condo|basement)\s+for\s+rent|for\s+rent\b|rental\s+application|open\s+house|realtor|broker|property\s+manager|first\s+and\s+last\s+month|per\s+month\s+plus\s+utilities)\b"),
    Rule("service-job-opportunity", "service-spam", "job/opportunity listing", 72, "high", "allText",
         r"\b(?:(?:work\s+from\s+home|remote\s+work)\s+(?:job|position|opportunit(?:y|ies)|income|available)|(?:remote|online)\s+(?:job|position|opportunit(?:y|ies))|(?:now\s+hiring|hiring\s+(?:now|immediately|today)|we'?re\s+hiring).{0,40}\b(?:apply|job|position|drivers?|workers?|reps?|sales|remote)|make\s+money\s+(?:online|from\s+home|daily|weekly)|earn\s+(?:extra\s+)?(?:cash|income|money)\s+(?:online|from\s+home|daily|weekly))\b"),
    Rule("service-income-hype", "service-spam", "income-hype wording", 30, "medium", "allText",
         r"\b(?:side\s+hustle|passive\s+income|business\s+opportunit(?:y|ies)|be\s+your\s+own\s+boss|set\s+your\s+own\s+schedule|unlimited\s+earning\s+potential|paid\s+daily|daily\s+pay)\b"),
    Rule("service-task-mlm", "service-spam", "task/MLM income pitch", 44, "high", "allText",
         r"\b(?:app\s+optimization|product\s+boosting|(?:rate|rating|review(?:ing)?)\s+(?:products|apps|hotels|restaurants)|join\s+(?:my|our)\s+team|become\s+(?:a\s+)?(?:distributor|consultant|brand\s+ambassador)|commission\s+(?:based|only)|residual\s+income|starter\s+kit\s+required)\b"),
    Rule("scam-deposit", "scam-pressure", "deposit or hold-fee pressure", 52, "high", "allText",
         r"\b(?:deposit\s+(?:required|first|via|through)|deposit\s+is\s+(?:necessary|needed|required)|deposit\s+(?:is\s+necessary\s+|is\s+required\s+)?to\s+(?:hold|secure|reserve)|send\s+(?:a\s+)?\$?\d*\s*deposit|hold\s+fee|non[-\s]?refundable\s+deposit|deposits?\s+are\s+(?:fully\s+)?refundable|pay\s+to\s+hold|reservation\s+fee|holding\s+fee)\b"),
    Rule("scam-payment-app", "scam-pressure", "payment app pressure", 42, "high", "allText",
         r"\b(?:zelle\s+only|cash\s*app\s+only|venmo\s+only|apple\s+pay\s+only|paypal\s+(?:friends\s+and\s+family|f\s*&\s*f)\s+only|crypto\s+only|wire\s+transfer\s+(?:only|required)|payment\s+(?:up\s*front|in\s+advance|before\s+(?:pickup|meeting|delivery)))\b"),
    Rule("scam-shipping-only", "scam-pressure", "shipping/off-platform pressure", 38, "medium", "allText",
         r"\b(?:shipping\s+only|no\s+(?:local\s+)?pickup(?:\s+possible|\s+available)?[,.]?\s+(?:shipping|ship|courier)|courier\s+only|escrow|(?:i'?m|i\s+am|currently)\s+(?:out\s+of\s+(?:town|state|country)|overseas|deployed|relocated).{0,60}\b(?:ship|shipping|courier|mail)\b)\b"),
    Rule("scam-fake-payment-upgrade", "scam-pressure", "fake payment/account-upgrade language", 72, "high", "allText",
         r"\b(?:(?:payment|funds?|money)\s+(?:is\s+|are\s+)?(?:pending|on\s+hold|sent|confirmed|released)|on\s+hold\s+due\s+to|(?:zelle|venmo|paypal|cash\s*app)\s+account\s+limit|(?:upgrade|expand)\s+(?:your\s+|my\s+)?account|(?:upgrade|convert)\s+(?:to\s+)?(?:a\s+)?(?:your\s+)?(?:zelle|venmo|paypal|cash\s*app)?\s*business\s+account|business\s+account\s+(?:fee|upgrade|limit)|release\s+(?:the\s+)?funds?|refund\s+the\s+(?:fee|upgrade)|you\s+will\s+be\s+refunded)\b"),
    Rule("scam-remote-seller", "scam-pressure", "absent-seller arrangement", 30, "medium", "allText",
         r"\b(?:(?:i'?m|i\s+am|i'?ll\s+be|currently|owner\s+is)\s+out\s+of\s+(?:town|state|the\s+country)|(?:my|the)\s+(?:assistant|agent|secretary|movers?)\s+will\s+(?:coordinate|handle|pick|meet)|on\s+mission(?:ary)?\s+work|deployed\s+overseas)\b"),
    Rule("scam-verification-code", "scam-pressure", "verification-code request", 74, "high", "allText",
         r"\b(?:(?:send|share|text|give|read)\s+(?:me\s+)?(?:back\s+)?(?:the\s+)?(?:six|6)[-\s]?digit\s+(?:code|verification|number)|(?:google\s+voice|verification|security|confirmation)\s+code|code\s+to\s+(?:verify|confirm)\s+(?:you|yourself))\b"),
    Rule("scam-gift-card-crypto", "scam-pressure", "gift-card/crypto payment pressure", 74, "high", "allText",
         r"\b(?:pay(?:ment)?\s+(?:by|with|via|in)\s+(?:gift\s*cards?|bitcoin|crypto|cryptocurrency|usdt|btc)|(?:apple|google\s+play|steam|visa|vanilla|amazon)\s+gift\s*cards?\s+(?:only|required|payment|accepted)|(?:bitcoin|crypto|cryptocurrency|usdt|btc)\s+(?:only|required|payment|accepted))\b"),
    Rule("scam-financial-opportunity", "scam-pressure", "financial scheme pitch", 72, "high", "allText",
         r"\b(?:forex|trading\s+signals?|crypto\s+(?:signals?|mentor(?:ship)?|course|training|investment|opportunit(?:y|ies))|investment\s+opportunit(?:y|ies)|guaranteed\s+(?:returns?|profits?|income)|double\s+your\s+money|(?:flip|turn)\s+\$\d+|loan\s+approval|guaranteed\s+approval\s+loans?|no\s+credit\s+check\s+loans?|bad\s+credit\s+loans?|personal\s+loans?|payday\s+loans?|debt\s+(?:relief|consolidation)|funding\s+available|processing\s+fee\s+(?:required|upfront)|upfront\s+(?:processing\s+)?fee)\b"),
    Rule("scam-overpayment-refund", "scam-pressure", "overpayment/refund scam language", 72, "high", "allText",
         r"\b(?:overpaid|over\s+payment|sent\s+(?:you\s+)?extra|extra\s+(?:money|amount|funds)|refund\s+the\s+(?:difference|extra|rest)|send\s+back\s+the\s+(?:difference|extra)|check\s+for\s+more\s+than|cashier'?s\s+check.{0,50}\b(?:refund|difference|extra)\b)\b"),
    Rule("catalog-generic-copy", "catalog-copy", "generic catalog copy", 24, "medium", "allText",
         r"\b(?:perfect\s+for\s+any\s+(?:room|space|home)|elevate\s+your|enhance\s+your\s+(?:space|home|living)|modern\s+minimalist|sleek\s+design|ergonomic\s+design|premium\s+quality|high[-\s]?quality\s+materials|crafted\s+from\s+premium|breathable\s+mesh|upgrade\s+your\s+(?:space|home|setup))\b"),
    Rule("catalog-sku-heavy", "catalog-copy", "SKU/retail item-number copy", 24, "medium", "allText",
         r"\b(?:sku\s*[:#]?\s*\w+|item\s*(?:no\.?|number|#)\s*\w+|upc\b|asin\b)\b"),
    Rule("catalog-spec-boilerplate", "catalog-copy", "retail spec boilerplate", 14, "low", "allText",
         r"\b(?:assembly\s+required|product\s+dimensions|package\s+includes|weight\s+capacity|retail\s+(?:price|value)|msrp)\b"),
    Rule("catalog-reference-photo", "catalog-copy", "reference/stock photo disclaimer", 42, "medium", "allText",
         r"\b(?:(?:stock|catalog|sample|example|representative)\s+(?:photos?|pictures?|pics?|images?)(?:\s+only|\s+for\s+(?:reference|example|display|illustration))?|(?:photos?|pictures?|pics?|images?)\s+for\s+reference\s+(?:only|not\s+actual)|(?:photos?|pictures?|pics?|images?)\s+(?:are\s+)?(?:for\s+)?(?:reference|example|display|illustration)\s+only|(?:photos?|pictures?|pics?|images?)\s+(?:is|are)\s+not\s+(?:the\s+)?actual(?:\s+(?:item|unit|product|one|photo|picture|pic|image))?|not\s+(?:the\s+)?actual\s+(?:item|unit|product|photo|picture|pic|image|one)|actual\s+(?:item|unit|product|color|colors?)\s+may\s+(?:vary|differ))\b"),
    Rule("gem-estate-moving", "gem-positive", "human sale context", -24, "medium", "allText",
         r"\b(?:estate\s+sale|moving\s+sale|garage\s+sale|yard\s+sale|downsizing|clearing\s+out|must\s+go|pickup\s+only|pick\s*up\s+only|curb\s+alert|first\s+come\s+first\s+serve)\b"),
    Rule("gem-condition-details", "gem-positive", "real condition details", -20, "medium", "allText",
         r"\b(?:used\s+for|owned\s+for|gently\s+used|barely\s+used|pre[-\s]?owned|second[-\s]?hand|like\s+new|(?:good|great|excellent|fair|poor|mint|working)\s+condition|used\s*[-\s]\s*(?:good|fair|like\s+new)|works(?:\s+(?:great|well|perfectly|fine|but))?(?!\s+with)|tested(?:\s+and\s+working)?|factory\s+reset|reset\s+to\s+factory|charger\s+included|remote\s+included|no\s+(?:charger|remote|stains?|rips?|tears?|issues?|damage)|battery\s+(?:holds|health|needs|weak)|screen\s+(?:cracked|scratched?|scratch(?:es)?)|minor\s+(?:wear|scuffs?|scratches?)|small\s+(?:tear|rip|chip|stain|dent|scratch)|as[-\s]?is\b|needs\s+(?:tlc|repair|work|cleaning|a\s+bulb)|scratches?|dents?|normal\s+wear|patina|missing\s+(?:one|a)|smoke[-\s]?free|pet[-\s]?free|one\s+owner|adult\s+owned|well[-\s]maintained)\b"),
    Rule("gem-material-vintage", "gem-positive", "gem-positive item detail", -18, "low", "allText",
         r"\b(?:solid\s+(?:wood|oak|maple|teak|mahogany|walnut)|hardwood|vintage|mid[-\s]?century|mcm\b|antique|handmade|hand[-\s]carved|heirloom|reupholstered|refinished)\b"),
]

# ---- fixed values: controls of the rules that are computed: id, category, reason, weight, confidence ----
DYNAMIC_CONTROLS: list[tuple[str, str, str, int, str]] = [
    ("bait-price-dynamic", "bait-pricing", "bait/display price mismatch", 50, "high"),
    ("keyword-stuffing-detected", "keyword-stuffing", "keyword stuffing", 34, "medium"),
    ("counterfeit-luxury-underpriced", "counterfeit", "suspicious price for branded item", 34, "medium"),
    ("counterfeit-authenticity-dodge", "counterfeit", "authenticity dodge on branded item", 30, "medium"),
    ("duplicate-flood-dynamic", "duplicate-flood", "repeat of a visible listing", 80, "high"),
    ("store-sponsored-card", "store-business", "sponsored marketplace ad", 74, "high"),
    ("image-catalog-photo", "catalog-copy", "retailer-style stock photo", 18, "medium"),
    ("missing-human-context", "missing-human", "commercial text without condition detail", 14, "low"),
    ("vendor-retail-combo", "known-vendor", "vendor source + retail-style wording", 26, "medium"),
]

# ---- fixed values: quick toggles ----
TOGGLES: list[Toggle] = [
    Toggle("dropship-sources", "vendor", "Amazon/Temu-sourced items", ("vendor-amazon", "vendor-temu", "vendor-aliexpress", "vendor-alibaba", "vendor-wish", "vendor-shein", "vendor-dhgate", "vendor-banggood", "vendor-tiktok-shop", "vendor-shopify",)),
    Toggle("ikea", "vendor", "IKEA items", ("vendor-ikea",)),
    Toggle("brand-new-resale", "vendor", "Brand-new / in-box items", ("new-in-box-title",)),
    Toggle("liquidation", "vendor", "Liquidation & pallet sales", ("store-liquidation-outlet",)),
    Toggle("sponsored-cards", "binary", "Sponsored ads", ("store-sponsored-card",)),
    Toggle("catalog-copy", "binary", "Stock-photo & catalog copy", ("catalog-reference-photo", "catalog-generic-copy", "catalog-sku-heavy", "catalog-spec-boilerplate",)),
    Toggle("duplicate-flood", "binary", "Repeated listings", ("duplicate-flood-dynamic",)),
    Toggle("not-for-sale", "binary", "Not-for-sale posts", ("not-for-sale-title-request", "not-for-sale-request-language", "not-for-sale-trade-only", "not-for-sale-unavailable",)),
    Toggle("opportunity-scams", "binary", "Job & money-making pitches", ("service-job-opportunity", "service-income-hype", "service-task-mlm", "scam-financial-opportunity",)),
    Toggle("weak-commercial", "binary", "Vague commercial listings", ("store-sales-language", "missing-human-context",)),
]

# ---- fixed values: categories ----
CATEGORIES: list[tuple[str, str]] = [
    ("known-vendor", "Known vendors"),
    ("dropship-phrasing", "Dropship phrasing"),
    ("store-business", "Stores and dealers"),
    ("bait-pricing", "Bait pricing"),
    ("external-redirect", "External redirects"),
    ("keyword-stuffing", "Keyword stuffing"),
    ("not-for-sale", "Not for sale"),
    ("service-spam", "Service spam"),
    ("scam-pressure", "Scams and payment pressure"),
    ("counterfeit", "Counterfeits"),
    ("duplicate-flood", "Duplicate floods"),
    ("catalog-copy", "Catalog copy"),
    ("missing-human", "Missing human context"),
    ("gem-positive", "Gem-positive signals"),
    ("custom-rules", "Your custom rules"),
]

# ---- fixed values: lexicons, patterns and constants of the computed rules and of extraction ----
CONDITION = r"\b(?:used|owned|gently\s+used|pre[-\s]?owned|like\s+new|(?:good|great|excellent|fair|poor|mint|decent|rough|working)\s+condition|condition\s*:?\s*(?:is\s+)?(?:good|great|excellent|fair|poor|decent|used|like\s+new)|no\s+stains?|as[-\s]?is|needs\s+tlc|scratch|scratches|dent|dents|wear|worn|scuffs?|works|broken|repair|pickup|pick\s+up|smoke[-\s]?free|pet[-\s]?free|measurements?|dimensions?|moving|estate|garage\s+sale|private\s+sale|one\s+owner|clean\s+(?:title|carfax)|no\s+accidents?|well[-\s]maintained|selling\s+because)\b"
RETAIL = r"\b(?:brand[\s-]?new|new\s+in\s+box|sealed|inventory|stock|order|wholesale|warehouse|showroom|tax|financing|condition\s*:?\s*(?:brand[\s-]?)?new\b)"
VENDOR_BRANDS = r"\b(?:amazon|temu|aliexpress|alibaba|wish|shein|wayfair|walmart|target|ikea|costco|home\s*depot|lowe'?s|overstock|dhgate|ashley|west\s+elm|pottery\s+barn|crate\s*&?\s*barrel|cb2|restoration\s+hardware|rh)\b"
CATEGORY_NOUNS = r"\b(?:sofa|couch|sectional|loveseat|recliner|chair|chairs|table|desk|dresser|nightstand|bookshelf|mattress|bed|bedroom|dining|wardrobe|cabinet|hutch|bench|ottoman|futon|daybed|iphone|samsung|galaxy|pixel|macbook|laptop|tablet|ipad|monitor|tv|television|console|playstation|xbox|nintendo|stroller|crib|bassinet|treadmill|elliptical|dumbbells?|weights|bike|bicycle|scooter|drill|saw|mower|trimmer|generator|washer|dryer|fridge|refrigerator|freezer|stove|oven|microwave|dishwasher)\b"
LUXURY_BRANDS = r"\b(?:louis\s+vuitton|lv|gucci|chanel|prada|dior|herm[eè]s|rolex|cartier|balenciaga|ysl|saint\s+laurent|goyard|bottega|celine|fendi)\b"
HYPE_BRANDS = r"\b(?:air\s+jordan|jordan\s+\d|nike\s+dunk|yeezy|moncler|canada\s+goose|off[-\s]white|supreme)\b"
LUXURY_ITEMS = r"\b(?:bag|bags|purse|wallet|watch|watches|sneaker|sneakers|shoes|sunglasses|belt|jacket|coat|hoodie)\b"
STRONG_AUTHENTICITY = r"\b(?:authenticated\s+by|certificate\s+of\s+authenticity|receipt\s+included|original\s+receipt|proof\s+of\s+purchase|comes\s+with\s+(?:box\s+and\s+receipt|original\s+receipt|receipt|papers)|box\s+and\s+papers|full\s+set)\b"
AUTHENTICITY_DODGE = r"\b(?:authenticity\s+(?:not\s+guaranteed|unknown)|looks\s+(?:real|authentic)|can'?t\s+(?:verify|prove)\s+(?:it'?s\s+)?(?:real|authentic)|i\s+don'?t\s+know\s+if\s+(?:it'?s\s+)?real|no\s+questions\s+about\s+authenticity)\b"
PRICE_DISCLOSURE = r"\b(?:actual|real|regular|full)\s+price\b|\b(?:prices?\s+in\s+(?:description|desc)|(?:read|see|check)\s+(?:the\s+)?desc(?:ription)?\b|description\s+has\s+(?:the\s+)?price|deposit|down\s+payment|per\s+month|monthly|not\s+(?:the\s+)?actual\s+price|message\s+(?:me\s+)?(?:for\s+)?price|dm\s+(?:me\s+)?(?:for\s+)?price|ask\s+for\s+price|price\s+varies|listed\s+(?:at\s+\$?\d+\s+)?for\s+(?:visibility|the\s+algorithm|search))\b"
LOOKS_NEW = r"\b(?:brand\s+new|new\s+in\s+box|deadstock|ds\b|never\s+worn|sealed)\b"
HUMAN_SALE = r"\b(?:estate\s+sale|moving\s+sale|garage\s+sale|yard\s+sale|downsizing)\b"
HUMAN_BUNDLE = r"\b(?:moving|garage|estate|yard)\s+sale\b|\bdownsizing\b|\blot\b|\bbundle\b"
HIDDEN_PRICE = r"\b(?:free|contact\s+for\s+price|message\s+for\s+price|ask\s+for\s+price)\b"
SPONSORED_LINE = r"^sponsored(?:\s*[·\-|]\s*(?:ad|paid|listing))?$"
AMOUNT = r"\$\s*([0-9][0-9,]*(?:\.\d{1,2})?)"
FINGERPRINT_DROP = r"\b(?:brand\s+new|new|sealed|available|delivery|pickup|firm|obo|must\s+go)\b"
EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"\b(?:\+?1[\s.-]?)?(?:\(?[2-9]\d{2}\)?[\s.-]?[2-9]\d{2}[\s.-]?\d{4})\b"
HUMAN_WORDS = r"\b(?:used|owned|pickup|moving|scratches?|wear|works|estate|garage|condition|smoke[-\s]?free)\b"
CARD_PRICE = r"^(?:free|contact|(?:ca|us|au)?\$\s*[0-9]|£\s*[0-9]|€\s*[0-9])"
# the rule that the permissive profile switches off
NEW_IN_BOX_RULE = "new-in-box-title"
# parts of link targets that lead to another listing or to an ad unit
OTHER_LISTING_LINKS = ("/marketplace/item/", "/marketplace/shops/item/", "/marketplace/np/item/", "/ads/about")
DETAIL_PRICE = r"^(?:free$|(?:ca|us|au)?\$\s*[0-9]|£\s*[0-9]|€\s*[0-9])"
AWAY_LINE = r"\b(?:mi|km)\s+away\b"
PLACE_LINE = r"^[A-Za-zÀ-ÿ' .-]{2,40},\s*[A-Z]{2}$"
NOT_TITLE = r"^(?:sponsored|just\s+listed|listed|ships?|location)"
SELLER_LINE = r"\b(?:listed|sold)\s+by\s+\S.{1,}|^(?:seller|dealer|store|shop)\s*:?\s+\S.{1,}"
SELLER_CHROME = r"\b(?:seller\s+(?:information|details)|view\s+(?:seller\s+)?profile|seller\s+ratings?)\b"
GENERIC_FINGERPRINT_WORDS = ("a", "an", "and", "for", "free", "in", "of", "on", "or", "the", "to", "used", "with")
GENERIC_TITLE_WORDS = ("a", "an", "and", "for", "free", "new", "obo", "of", "or", "the", "used", "with")
PLACEHOLDER_PRICES = (123, 1234, 12345, 1111, 9999)
THRESHOLDS = {"relaxed": (28, 48, 86), "balanced": (20, 34, 72), "strict": (18, 26, 58)}  # label, dim, hide
PROFILE_NOISY_RULES = ("duplicate-flood-repeat", "store-sales-language", "missing-human-context")
# parts and beginnings of link targets of ad units
AD_LINKS = ("/ads/about", "l.facebook.com/l.php")
AD_LINK_START = "https://l.facebook.com"
# discovery of cards: parents climbed, least and most text of a card, text and links beyond which it is none, least size in pixels
CLIMB, CARD_TEXT_MIN, CARD_TEXT_MAX, CARD_TEXT_STOP, CARD_LINKS_STOP, CARD_WIDTH, CARD_HEIGHT = 9, 8, 1400, 1600, 3, 90, 70
LABELS_MAX, LABEL_CHARS_MAX = 12, 80
LONE_SPONSORED = r"^sponsored$"
# how far beyond the window listings are looked at, in window heights
LOOKAHEAD = 1.25
