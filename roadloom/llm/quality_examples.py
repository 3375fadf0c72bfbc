"""Labelled example texts from which the model of ``quality`` is fitted; all are made up.

Each state of the model has some; every line of an example is one of its state.
"""

EXAMPLES = {
    "prose": (
        "The hinge feels solid and moves without any fuss. I would buy it again.",
        "works fine no complaints from me so far",
        "Bad zip. Sent it back!",
        "I WOULD BUY IT AGAIN, THE COLOUR IS JUST RIGHT!",
        "Arrived late, but the seller answered the same day and the box was whole",
        "Die Lampe steht fest und das Kabel ist lang genug.",
        "nach zwei wochen ging der motor nicht mehr",
        "Funciona bien y no hace ruido, lo compraría otra vez.",
        "la tapa no cierra y el vendedor no responde",
        "Le moteur est silencieux, je suis content de mon achat.",
        "livré en retard et la notice manque",
        "El tÃ©cnico ajustÃ³ el borde y apuntÃ³ la fecha.",
        "Das GerÃ¤t lÃ¤uft gut, fÃ¼r den Preis okay.",
        "<p>The lid is heavy.<br/>I use it every day, and so does my son.</p>",
        "We had it for 3 weeks now; 2 of 5 screws came loose.",
        "Bought 2 in 2023, both still work 😀",
        "It says 5 kg at https://shop.invalid/x but mine holds 3 kg at best.",
        "Great value for the money, fast shipping and a friendly seller who even called us",
        "not good",
        "I bought this lamp for the hall last spring and\nit has done well since. The switch is on the\ncable, which took a while to get used to, and\nthe shade gets warm after some hours.",
        "We use it in the garden every day.\nMy brother broke the old one.\nThis one is heavier, but it holds.\nWould order it again.\nThe box was fine.",
        "Wir haben den Topf seit drei Jahren und\nbenutzen ihn jede Woche. Der Deckel ist\nschwer, aber er hält die Hitze sehr gut\nund lässt sich leicht reinigen.",
        "Está bien hecho y no pesa mucho.\nLo uso todos los días en la oficina.\nEl cable es corto, pero me sirve.\nNo lo cambiaría por otro.",
        "Nous l'avons depuis un an.\nIl fait du bruit la nuit.\nLe service n'a pas répondu.\nJe ne le conseille pas.",
    ),
    "title": (
        "Very pleased",
        "Worth 38 euros",
        "Not again",
        "Solid kettle",
        "Better than hoped",
        "Happy with the hinge",
        "Disappointing!",
        "Enttäuschend",
        "Gerne wieder",
        "Hält was er verspricht",
        "Très satisfait",
        "Bon achat",
        "Déçu",
        "Muy contento",
        "No lo recomiendo",
        "Five stars",
        "ok",
        "Super",
        "Would not buy again",
        "GREAT LAMP",
        "Top 10 of all",
    ),
    "list": (
        "- soft grip\n- wide base\n- heavy lid\n- loud fan",
        "1. quiet\n2. light\n3. long hose\n4. no manual",
        "a) Nice box\nb) Quiet\nc) Light\nd) Fair price",
        "* leise\n* leicht\n* gutes Kabel",
        "• rápido\n• buen precio\n• tapa firme\n• sin ruido\n• ligero",
        "+ léger\n+ solide\n- bruyant\n- notice absente\n- cher",
    ),
    "bare": (
        "quiet\nlong hose\ngood colour\nslow reply\nwide base\nspare screws",
        "Pros\nquiet\nlight\nCons\nloud fan\nno manual",
        "leise\nleicht\ngutes Kabel\nschöne Farbe",
        "rápido\nbuen precio\ntapa firme\nsin ruido",
        "léger\nsolide\nbon prix\nnotice claire",
    ),
    "table": (
        "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |",
        "size\tprice\nL\t5.0\nM\t6.0",
        "item;price;size\ntent;5.00;L\nlamp;7.50;M",
        "price,score,code\n58.18,10/10,K1\n153.66,8/10,K2",
        "1/10           K53559         25.01\n3/10           K49195         77.58",
        "item | size\ntent | L\ndesk lamp | M",
        "price          score          pack\n114.97         7/10           9\n20.92          8/10           4",
        "pack\tcode\tcolour\n4\tK77120\tred\n9\tK10443\tdark blue",
        "Produkt;Preis\nZelt;5,00\nLampe;7,50",
        "name    size    weight\nlamp    L       1.2 kg\ntent    XL      3.5 kg",
    ),
    "signs": (
        "😀🎉🔥👍",
        "^&^?$~=?*^=~",
        "-",
        "!!! ??? !!!",
        "😀 😀 😀\n🔥🔥",
        "... --- ...",
        "####@@@@",
        "👍",
    ),
    "figures": (
        "684 1727714 329",
        "12345678",
        "4 8 15 16 23 42",
        "K53559 Q88120 Z1",
        "58.18 10/10 153.66",
        "B0774XKQ",
        "00:11:22:33",
    ),
    "garbled": (
        "Ã¿‚‚¿ÂÂÃâ¤¢¢�ÃÃ»",
        "�����¿½Ã¯",
        "Ãƒâ€žÃ‚Â¼ÃƒÂ¶",
        "Ð¿Ñ€Ð¸Ð²ÐµÑ‚",
        "Ââ¤¢ ¿Ã»Â ¶¶Ã¸",
    ),
    "echo": (
        "ok ok ok ok ok ok ok",
        "ok\nok\nok\nok\nok\nok",
        "hahahahaha",
        "aaaaaaaaaaaa",
        "bad bad,bad bad,bad bad",
        "good good good good good good good good",
        "la la la la la la la la",
        "muy muy muy muy muy muy muy",
        "nicht nicht nicht nicht nicht nicht",
        "test test test test test test",
        "lololololol",
        "the the the the the the the",
        "très très très très très très très très très très",
        "und und und und und und und und und und und",
        "no no no no no no no no no no no no",
        "very,very,very,very,very,very,very,very,very,very",
        "fine fine\nfine fine\nfine fine\nfine fine\nfine fine",
        "nice\nnice\nnice\nnice\nnice\nnice\nnice",
        "gut gut\ngut gut\ngut gut\ngut gut\ngut gut\ngut gut",
    ),
    "mash": (
        "lfhshlsjsad dkdd dkfsg jkjj",
        "asdf jkl asdfg hjkl",
        "sdfgh jklsdf kjhgf",
        "xcvbn zxcv mnbvc",
        "qwrtp sdfgh zxcvb kjhgt",
        "fjdkslfjdk sldkfjgh dkfjghdk",
        "jkhgf dskjh",
        "dfgkjhdfkgjh",
        "ajskdl sakdfj lasdk fajksd",
        "gafhs dakgh lsafd",
    ),
    "code": (
        "r0yMxuWTpbVJpXVIG5JWFoHInz5OGBNCUqqw2180YdfN8DTOeRMN",
        "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Q",
        "deadbeefcafebabe0123456789abcdef0123",
        "QmFzZTY0IGlzIG5vdCBwcm9zZSBhdCBhbGw",
    ),
    "links": (
        "http://a.invalid/x1 http://b.invalid/y2",
        "https://shop.invalid/item?id=4471",
        "www.example.invalid/a/b/c",
        "<div><span class=\"r\">&nbsp;</span>{{body}}</div>",
        "&lt;br&gt;&nbsp;&nbsp;<td></td><tr>",
        "undefined [object Object] {{user.name}}",
        "<ul><li></li><li></li></ul>",
        "undefinedundefined<p></p>{{title}}<!-- --><br>undefined</p>&nbsp;{{title}}undefinedundefinedundefined",
        "<!-- --><br><br>{{footer}}undefined<p class='x'>&nbsp;</p>",
    ),
}
