"""Default Korean word lists and rules. All of these are fixed values, passed to operators as parameters."""

# fixed values: title stopwords
STOPWORDS = (
    "관련", "대한", "위한", "통해", "올해", "오늘", "내일", "지난", "이번", "정부", "대통령", "국민",
    "한국", "서울", "기자", "단독", "속보", "종합", "종합2보", "사진", "영상", "논평", "사설", "인터뷰",
    "한다", "했다", "된다", "밝혀", "가운데", "이후", "현재", "최근", "대해", "두고", "다시", "최대",
)

# fixed values: words too common to identify an event
GENERIC_EVENT_TOKENS = (
    "관련", "사건", "의혹", "논란", "특검", "검찰", "경찰", "법원", "정부", "국회", "청구", "수사", "조사",
    "구속영장", "압수수색", "긴급체포", "체포", "구속", "기소", "입건", "송치", "선고", "판결", "발표",
    "추진", "개최", "방문", "오늘", "내일", "전날", "지난", "이번", "속보", "종합",
    "광복절", "대통령", "여야", "국민",
)

# fixed values: words that identify a kind of event
DISTINCTIVE_EVENT_TOKENS = (
    "내란", "내란선전", "횡령", "배임", "마약", "살인", "폭행", "사기", "성폭력", "유출", "해킹",
    "화재", "산불", "지진", "참사", "추락", "충돌", "사망", "파업", "선거", "법안", "관세",
)

# fixed values: further body stopwords
BODY_STOPWORDS = STOPWORDS + GENERIC_EVENT_TOKENS + (
    "것", "수", "등", "때", "곳", "뒤", "앞", "안", "밖", "및", "또한", "따르면",
    "전해", "알려", "밝혀", "말했다", "설명했다", "기자", "사진", "자료", "관련기사",
)

# fixed values: particles cut from title and body tokens
TOKEN_PARTICLES = (
    "에서", "으로", "에게", "까지", "부터", "보다", "처럼", "과의", "와의", "에도", "에는",
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로",
)

# fixed values: role words that end a compound token
ROLE_SUFFIXES = (
    "검찰총장", "감사위원", "사령관", "교육감", "대통령", "총리", "장관", "의원", "대표", "시장", "도지사",
    "회장", "사장", "감독", "총장", "교수", "기자", "검사", "판사", "원장",
)

# fixed values: a person's name before a role word
ACTOR_PATTERN = (
    r"([가-힣]{2,4})(?:\s+전)?(?:\s+[A-Za-z0-9가-힣]{2,12})?\s*"
    r"(?:대통령|총리|장관|의원|대표|시장|도지사|교육감|회장|사장|감독|총장|검찰총장|감사위원|사령관|교수|기자|검사|판사|원장)"
)

# fixed values: action classes by signal word
ACTIONS = (
    ("warrant", ("구속영장", "영장 청구", "영장청구")),
    ("search", ("압수수색",)),
    ("arrest", ("긴급체포", "체포", "구속")),
    ("indictment", ("기소", "재판행")),
    ("booking", ("입건",)),
    ("referral", ("송치",)),
    ("ruling", ("선고", "판결", "결정")),
    ("investigation", ("수사", "조사")),
    ("legislation", ("발의", "의결", "법안")),
    ("announcement", ("발표", "공개")),
    ("accident", ("사고", "충돌", "추락")),
    ("death", ("사망", "숨진", "시신")),
    ("strike", ("파업",)),
    ("visit", ("방문", "파견")),
)

# fixed values: agenda concepts; every pattern of a concept must match the title
CONCEPTS = (
    ("supplementary-investigation-authority", (r"보완\s*수사권",)),
    ("platform-terms-fees", (r"쿠팡|배달앱|온라인\s*플랫폼", "약관|수수료|멤버십|해지|가격")),
)

# fixed values: titles that must not be merged when one matches each side
HARD_NEGATIVES = (
    (r"경축사|대북|전쟁\s*종식|상호\s*위협|주적", r"산책|k-?컬처|케이컬처|야스쿠니|탄도\s*미사일|독립유공자.{0,8}기부"),
    (r"이진숙.{0,12}(방통|방송통신|탄핵)", r"이진숙.{0,12}의원|5[·.]18|오월|토론회"),
    (r"특별사면|사면\s*복권|복권", r"부동산|당내.{0,6}선거|전당대회|경선|공천"),
    (r"친일.{0,8}재산|재산\s*환수", r"독립유공자.{0,8}(기부|성금)|광복회.{0,8}기부"),
)

# fixed values: categories
CATEGORY_SPORTS, CATEGORY_TECH = "스포츠", "생활·IT"
SPORTS_SECTION = r"(?i)스포츠|골프|야구|축구|농구|배구|e스포츠"
SPORTS_TITLE = r"프로야구|프로축구|프로농구|올림픽|월드컵|선수\s*(영입|이적)|감독\s*(선임|경질)"
EXCLUDED_SECTION = r"(?i)연예|문화|생활|여행|레저"
TECH_SECTION = r"(?i)IT|과학|테크|디지털|모바일|게임"
PUBLIC_TECH_TITLE = r"(?i)정부|국회|정책|규제|법안|공정위|조사|제재|소비자|노동|수수료|약관|독과점|플랫폼|반도체\s*(지원|투자|수출)|AI\s*(법|규제|정책)"
SECTION_CATEGORIES = (
    ("국제", "국제|세계|외교|북한"),
    ("정치", "정치|국회|대통령|정당"),
    ("경제", "경제|금융|산업|부동산|증권|기업"),
    ("사회", "사회|전국|지역|교육|복지|노동|환경|법조|사법|검찰"),
)
TITLE_CATEGORIES = (
    ("정치", "국회|대통령|여당|야당|정당|원내대표|지도부|의원|선거|정쟁|거취|검찰개혁|수사권"),
    ("경제", "금리|물가|주가|부동산|환율|고용|일자리|기업|금융|무역|세금|예산|증시|재정|수수료|약관|공정위|쿠팡|플랫폼"),
    ("사회", "검찰|경찰|수사|법원|헌재|기소|재판|영장|송치|판결|의혹|입건|노동|파업|사고|참사|재난|보건|복지|교육|환경|교통|안전|시위"),
    ("국제", "외교|안보|국방|북한|미사일|미국|중국|일본|정상회담|전쟁|트럼프"),
)

# fixed values: issue suffix classes
ISSUE_SUFFIXES = (
    ("갈등", "갈등|충돌|대립|공방"),
    ("논란", "논란|파문|의혹"),
    ("사고", "사고|참사|재난"),
    ("협상", "협상|합의|타결"),
    ("수사", "수사|조사|기소|체포"),
    ("동향", "정책|대책|방안|추진"),
)

# fixed values: keyword frames
FRAME_KEYWORDS = (
    ("conflict", ("갈등", "충돌", "논란", "반발", "대립", "공방", "비판", "파문", "강대강", "규탄")),
    ("responsibility", ("책임", "사퇴", "해명", "문책", "귀책", "책임론")),
    ("economy", ("경제", "금리", "물가", "주가", "환율", "고용", "일자리", "부동산", "수출", "투자", "세금", "예산")),
    ("law", ("법", "법원", "헌재", "재판", "수사", "검찰", "경찰", "기소", "판결", "규제", "제도")),
    ("policy", ("정책", "대책", "지원", "개편", "추진", "확대", "축소", "시행", "도입", "계획", "공급")),
    ("citizen", ("시민", "청년", "노인", "학생", "노동자", "환자", "소비자", "가구", "주민", "피해자")),
)

# fixed values: particles of the morphology
MORPH_PARTICLES = (
    "으로부터", "에게서는", "에게서", "에서는", "으로는", "로부터", "에게", "한테", "까지", "부터", "보다",
    "처럼", "만큼", "으로", "에서", "에는", "에도", "과의", "와의", "에게는", "께서", "만은", "만도",
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "만",
)
NEGATION_LEMMAS = ("않다", "아니다", "못하다", "없다")

# fixed values: irregular predicate forms
PREDICATE_FORMS = (
    ("하다", "하다|한다|했다|하는|하며|하여|해야|하지|하고|하면|해서|한|할|해|했|합니다|하였다"),
    ("되다", "되다|된다|됐다|되는|되며|되어|돼|되지|되고|되면|된|될|됩니다|되었다"),
    ("있다", "있다|있는|있었다|있으며|있어|있고|있다고|있지만|있습니다"),
    ("이다", "이다|이었다|이라는|이라고|인|입니다"),
    ("말하다", "말하다|말했다|말한다|말하며|말해|말하고|말했다가|말했습니다"),
    ("밝히다", "밝히다|밝혔다|밝힌|밝히며|밝혀|밝히고|밝혔고|밝혔다고|밝혔습니다"),
    ("전하다", "전하다|전했다|전한|전하며|전해|전하고|전했다고|전했습니다"),
    ("따르다", "따르다|따르면|따른|따랐다|따르고|따라|따랐습니다"),
)
NEGATION_FORM = "^(?:않|아니|못하|없)(?:았|었|다|다고|다는|으며|지만|거나|는|은|을|지|고|게|도록|습니다|습니까)*$"

# fixed values: predicate stems and the endings they take
PREDICATE_STEMS = (
    "강화", "완화", "개선", "보완", "개정", "폐지", "도입", "확대", "축소", "지원", "규제", "처벌", "비판",
    "지지", "우려", "반대", "찬성", "요구", "촉구", "설명", "주장", "발표", "평가", "침해", "보장", "훼손",
    "발생", "증가", "감소", "악화", "회복", "실패", "부족", "지연", "방치", "사과", "해명", "조사", "수사",
    "감독", "보호", "외면", "기여", "위협", "존중", "마련", "추진", "검토", "필요", "논의", "결정", "시행",
)
STEM_ENDINGS = (
    "하|해|했|한|할|하는|하며|하여|해야|하지|되|돼|됐|된|될|되는|시키|시켜|시켰|이다|인|일|였다|였|라고|라며|다|고|며|면서"
    "|지만|도록|습니다|습니까|았다|었다|는다|ㄴ다|자|길|기"
)
GENERIC_PREDICATE_ENDINGS = "했다|한다|하는|하며|해야|하지|하였다|됩니다|됐다|되었다|되는|된다"

# fixed values: lemmas that carry no topic
CONTENT_STOPWORDS = (
    "관련", "대한", "위한", "통해", "올해", "오늘", "내일", "지난", "이번", "현재", "최근", "가운데", "이후",
    "대해", "두고", "다시", "기자", "사진", "영상", "단독", "속보", "종합", "말하다", "밝히다", "전하다",
    "설명하다", "주장하다", "따르다", "그러나", "하지만", "또한", "한편", "다만", "그리고", "있다", "하다",
    "되다", "이다", "않다", "아니다", "못하다", "없다", "기사", "관련기사", "구독", "가장", "함께", "이상", "경우",
    "지난해", "이날", "위해", "같은", "다른", "이라고", "라고", "억원", "만원", "것이다", "것", "수", "등", "중", "때",
    "명", "건", "년", "월", "일",
)
