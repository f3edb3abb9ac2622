"""Fixed values that define results."""

#: BM25 and its gates.
K1, B = 1.2, 0.75
MIN_COVERAGE, STRONG_EVIDENCE, POOL_FLOOR = 0.25, 1.25, 20
#: Reciprocal-rank fusion.
RRF_K, VECTOR_WEIGHT, LEXICAL_WEIGHT = 20, 2.0, 1.0
#: Seats of an ambient selection.
CAP, QUOTAS = 8, (("turning_point", 3), ("recent", 2))
#: One-hop relations.
RELATED_CAP, SUMMARY_CHARS, LINK_CHARS, LINKS_PER_FIELD = 6, 120, 160, 20
#: Language vote.
MIN_UNITS, MIN_CONFIDENCE = 12, 0.62
#: Maintenance.
DREAM_SOURCE, MIN_NEW_CARDS, FUSE_RATIO, FUSE_CARDS, ID_LEAK_CHARS = "memory_dream", 10, 0.8, 10, 8
#: Paging and reading.
PAGE_DEFAULT, PAGE_MOST, CHUNK_DEFAULT, CHUNK_MOST = 100, 1000, 5000, 20000
#: Import.
BATCH_CHARS, MOST_CANDIDATES = 6000, 4000
SESSION_TTL = "15 minutes"

#: Words dropped from queries (never from cards).
STOPWORDS = tuple(
    dict.fromkeys(
        """
的 地 得 了 着 过 是 在 有 没 不 也 都 就 还 又 和 与 跟 及 把 被 让 给 对 从 向 为
我 你 您 他 她 它 们 这 那 哪 谁 啥 什 么 怎 吗 呢 吧 啊 呀 嘛 哦 嗯 个 些 一
什么 怎么 怎样 怎么样 为什么 哪个 哪里 哪些 哪儿 我们 你们 他们 她们 它们 自己
这个 那个 这些 那些 这样 那样 没有 有没 一个 一下 就是 还是 可以 是不 不是 的是 了吗
来着 到底 然后 后来 之前 之后 时候 现在 以前 上次 那次 这次
a an the and or but of to in on at by for with from as into about
i me my mine we our you your he him his she her it its they them their
is am are was were be been being do does did done have has had having
what whats which who whom whose when where why how
this that these those there here
can could would should will shall may might must
s t d ll m re ve
any some not no yes
""".split()
    )
)
