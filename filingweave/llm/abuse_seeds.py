"""Seed sentences of the abuse model: passages that are abusive and passages that are not. None of them shares four words in
a row with the given documents."""

ABUSIVE = [
    "you are an idiot and everyone knows it",
    "what a stupid piece of shit you are",
    "you lying bastard, go to hell",
    "shut your mouth you worthless pig",
    "you lot are leeches feeding off honest folk",
    "these managers are morons and so is whoever hired them",
    "only a moron would believe this, you dickhead",
    "you useless arsehole, nobody wants you here",
    "the world would be better without you, go and hang yourself",
    "do us all a favour and drop dead",
    "piss off and crawl back to your hole",
    "your parents should have drowned you at birth, bastard",
    "a rat has more brain than you, retard",
    "how can one person be so dumb, you halfwit",
    "you are the scum of the earth, stop posting",
    "bunch of liars and parasites, rot in hell",
    "you disgust me, crawl away you filthy swine",
    "the smell of your post is like you, rotten",
    "bankers, every one of them, are scum",
    "immigrants are a plague of vermin, deport every last one",
    "those people are not human, they are beasts",
    "they breed like cockroaches and steal from decent folk",
    "send the foreigners back where they came from, filthy animals",
    "wipe that tribe off the map",
    "women have no business here, they belong in the kitchen",
    "their kind steals from birth, lock them all up",
    "god made those people to serve, not to think",
    "migrants ruin this land, kick them out",
    "this race should be wiped out, they pollute our blood",
    "never hire them, filthy dogs all of them",
    "nothing good comes from hiring natives, they are lazy and inferior",
    "wait until I get my hands on you, you will bleed like a pig",
    "write one more word and they will carry you out with broken bones",
    "we have your address, so sleep with one eye open",
    "set fire to the place and let them burn",
    "a bullet would be cheaper than your salary, remember that",
    "we know where your children go to school, so drop it",
    "pretty daughters you got, shame if something happened to them",
    "I will kill you, you will be sorry",
    "you are a dead man, count the hours",
    "keep talking and I will slit your throat",
    "I keep dreaming of taking her clothes off and kissing every inch of her naked body",
    "take your clothes off for me tonight, darling, I am horny",
    "got any nudes for me, sweet thing",
    "give me ten minutes alone with her and I would fuck her senseless",
    "nice boobs, take off that blouse",
    "I get hard when I think of you naked",
    "we had sex in the lift and she moaned like a whore",
    "she only got the job because she sucks the boss's dick",
    "I bet that receptionist gives great head",
    "sexy lady, let me put my dick inside you",
    "otak kau kosong, dasar tolol",
    "bangang betul kau ni, muka macam sial",
    "diam lah anjing, tiada siapa mahu dengar",
    "celaka punya orang, aku bakar rumah kamu nanti",
    "pendatang macam mereka patut dihalau, semuanya penjenayah dan binatang",
    "perempuan itu sedap kalau aku bogelkan",
    "aku bunuh kamu nanti, celaka",
    "蠢货，闭嘴滚开",
    "你们都是废物，去死吧",
    "外国人全是垃圾，统统赶走",
    "王八蛋，我要打断你的腿",
    "他没脑子，狗都不如",
    "美女来做爱吧，我想看你的裸照",
]

HARMLESS = [
    "silly me, I sold at the bottom like a fool",
    "stupid question maybe, but does this include leases",
    "why the hell is it halted",
    "damn fine quarter, bloody brilliant",
    "shit day, everything red, going for a beer",
    "this trade murdered my account",
    "bears will get crushed and burn when the order lands",
    "damn, I am such a fool for buying the dip",
    "my own stupid mistake, I feel like a clown",
    "a post that insulted the miners as morons has been removed",
    "one of your agents said I was dumb, which hurt",
    "staff who call others pigs or idiots face a hearing",
    "anyone who swears at a fellow worker will be warned",
    "the policy forbids threats, insults and sexual remarks at work",
    "did anyone tell the police about the threats against our drivers",
    "how many cases of harassment did the panel hear and what were the outcomes",
    "the court heard that the accused had threatened to kill the director",
    "the report says that a worker was beaten and had his legs broken",
    "the newspaper quoted him as calling investors fools",
    "training on harassment and hate speech is compulsory",
    "kill switch and trigger price stay as they are",
    "shoot over your notes when ready",
    "sex and date of birth are required fields",
    "the pilot showed the children his cockpit",
    "the adult education wing sold more courses",
    "the bid was hostile but the board stood firm",
    "no naked options were written by the fund",
    "that columnist misses every call he makes",
    "the service was poor and nobody apologised to my parents",
    "losing a cheque twice is shameful work",
    "calls to the branch go unanswered, please fix it",
    "this is the worst plan I have read, management should resign",
    "the results are terrible and the board has failed its owners",
    "the help desk gave me two different answers",
    "I think your estimate is too high and your method is weak",
    "will you keep the dividend if inventories rise",
    "added more at the lows, hope it holds",
    "the company breeds pigs and dogs at two farms",
    "the head of sales will ride out the hard year",
    "the women on the board were elected in May",
    "foreigners hold a third of the shares and migrants work on the site",
    "native title claims of the tribe are described in the notes",
    "employees from that town make up half of the staff",
    "the clan association held its annual dinner",
    "please watch the webcast before you vote",
    "breakdown of the plant burned cash and hurt margins",
    "the acid plant and the bomb disposal unit were sold",
    "Syarikat yakin permintaan akan pulih tahun hadapan",
    "aduan tentang ancaman dan kata kesat telah disiasat",
    "saya memang bodoh sebab jual awal",
    "Kumpulan mencatat hasil lebih tinggi berbanding suku sebelumnya",
    "管理层预计明年需求回升",
    "公司禁止辱骂同事，违者受处分",
    "我真是个白痴，太早卖了",
    "公司上季盈利上升，派息维持",
]
