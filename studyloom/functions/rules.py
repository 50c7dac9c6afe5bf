"""Rule tables as data, and the two ways to apply them: first match and all matches.

A rule is ``(label, conditions)``; a condition is ``(column key, pattern, wanted)`` and a rule holds when every
condition does. Rules become one CASE expression, so a row stops at its first hit and nothing is joined.
"""
from functools import reduce

from pyspark.sql import functions as F


def has(key, rx):
    return (key, rx, True)


def lacks(key, rx):
    return (key, rx, False)


def _holds(cols, conds):
    tests = [F.coalesce(cols[k].rlike(rx), F.lit(False)) if want else ~F.coalesce(cols[k].rlike(rx), F.lit(False))
             for k, rx, want in conds]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def first_match(cols, rules, default=""):
    """Label of the first rule that holds."""
    case = None
    for label, conds in rules:
        case = F.when(_holds(cols, conds), label) if case is None else case.when(_holds(cols, conds), label)
    return case.otherwise(default) if case is not None else F.lit(default)


def all_matches(text, rules, default=None):
    """Array of the labels of all patterns found in ``text``; ``[default]`` when there is none."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(rx), name) for name, rx in rules]))
    return hits if default is None else F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def probe_match(probes, rules, default=""):
    """Every probe is tried against all rules before the next probe is."""
    tries = [F.nullif(first_match({"t": p}, [(n, [has("t", rx)]) for n, rx in rules]), F.lit("")) for p in probes]
    return F.coalesce(*tries, F.lit(default))


def weighted_theme(texts, weights, rules, default):
    """Theme with the largest weighted number of hits. Ties go to the theme seen in the earlier text, then listed first."""
    rows = []
    for i, (name, rx) in enumerate(rules):
        n = [F.regexp_count(F.coalesce(t, F.lit("")), F.lit(rx)) for t in texts]
        score = reduce(lambda a, b: a + b, [k * w for k, w in zip(n, weights)])
        seen = F.coalesce(*[F.when(k > 0, j) for j, k in enumerate(n)], F.lit(len(texts)))
        rows.append(F.struct(score.alias("s"), (-seen).alias("t"), F.lit(-i).alias("i"), F.lit(name).alias("n")))
    best = F.array_max(F.array(*rows))
    return F.when(best["s"] > 0, best["n"]).otherwise(default)


# Topic rules of the civil-service exam (topic id, module, sub-type or None, stem pattern; "" = rest).
IDIOM = "__IDIOM__"
TOPIC_RULES = [
    ("data-gap", "资料分析", None, r"隔年|间隔|比\s*20\d\d\s*年(同期)?(增长|下降|提高)"),
    ("data-annual", "资料分析", None, r"年均(增长|增速|增长率)?|平均每年"),
    ("data-mixed", "资料分析", None, r"(上半年|全年|一季度|前.季度).*(增速|增长率).*(下半年|二季度|后)"),
    ("data-share", "资料分析", None, r"比重|占比|所占|占.{0,12}(的|比例)|百分点"),
    ("data-rate", "资料分析", None, r"增长率|增速|增幅|同比(增长|下降)了?\s*(约|大约)?\s*(多少|百分之)|降幅"),
    ("data-amount", "资料分析", None, r"增长量|增加量|(增加|增长|减少|下降)了?\s*(约|大约)?\s*多少(?!%|个百分)"),
    ("data-base", "资料分析", None, r"上年(同期)?|去年(同期)?|20\d\d\s*年.{0,20}(约|大约)?(为|是)多少"),
    ("data-avg", "资料分析", None, r"平均|人均|户均|每(个|家|人|户|名)"),
    ("data-times", "资料分析", None, r"倍"),
    ("data-judge", "资料分析", None, r"(能够|可以).{0,8}推出|说法正确|正确的(是|有)|不正确|错误的是|下列说法"),
    ("data-other", "资料分析", None, r""),
    ("math-seq", "数量关系", "数字推理", r""),
    ("math-prob", "数量关系", None, r"概率|可能性"),
    ("math-perm", "数量关系", None, r"排列|组合|(多少|几)种|不同的(方案|选法|排法|安排)"),
    ("math-work", "数量关系", None, r"工程|完工|合作|单独(做|完成)|效率|工期"),
    ("math-travel", "数量关系", None, r"速度|相遇|追及|追上|行驶|千米|公里|米/秒|顺流|逆流|跑道|出发"),
    ("math-profit", "数量关系", None, r"利润|成本|售价|进价|定价|打.折|折扣|盈利|亏损|促销"),
    ("math-solution", "数量关系", None, r"浓度|溶液|盐水|糖水|酒精"),
    ("math-geo", "数量关系", None, r"面积|体积|周长|半径|直径|三角形|正方形|长方形|长方体|正方体|圆|棱|角度"),
    ("math-set", "数量关系", None, r"都不|都(会|喜欢|参加)|既.{1,12}又|两项都|三项都|只.{1,6}一项"),
    ("math-extreme", "数量关系", None, r"至少|最多|最少|最大|最小"),
    ("math-misc", "数量关系", None, r"年龄|岁|星期|日期|钟|植树|周期|牛吃草"),
    ("math-other", "数量关系", None, r""),
    ("reason-fig", "判断推理", "图形推理", r""),
    ("reason-def", "判断推理", "定义判断", r""),
    ("reason-ana", "判断推理", "类比推理", r""),
    ("reason-weaken", "判断推理", "逻辑判断", r"削弱|质疑|反驳|不能支持|动摇"),
    ("reason-strengthen", "判断推理", "逻辑判断", r"加强|支持|前提|假设|解释|论证.{0,4}(成立|有效)"),
    ("reason-truth", "判断推理", "逻辑判断", r"(只有|仅有).{0,4}(一|两)(句|个|人).{0,6}(真|假)|说了真话|说了假话|为真.*为假"),
    ("reason-trans", "判断推理", "逻辑判断", r"如果|只有.{1,20}才|除非|那么|推出|必然"),
    ("reason-arrange", "判断推理", "逻辑判断", r""),
    ("reason-other", "判断推理", None, r""),
    ("verbal-idiom", "言语理解与表达", "逻辑填空", IDIOM),
    ("verbal-word", "言语理解与表达", "逻辑填空", r""),
    ("verbal-order", "言语理解与表达", "语句表达", r"重新排列|排序|语序正确|排列.{0,4}(最|正确)|①"),
    ("verbal-fillsent", "言语理解与表达", "语句表达", r""),
    ("verbal-intent", "言语理解与表达", "片段阅读", r"意在|旨在|意图|想要(说明|表达)|用意|目的是"),
    ("verbal-title", "言语理解与表达", "片段阅读", r"标题|接下来|后文|下文|文段(之后|后面)"),
    ("verbal-detail", "言语理解与表达", "片段阅读", r"(符合|不符合|理解(正确|错误)|说法(正确|错误)|不正确|错误)"),
    ("verbal-main", "言语理解与表达", "片段阅读", r""),
    ("verbal-other", "言语理解与表达", None, r""),
    ("common-law", "常识判断", None, r"法|宪法|刑|罪|民事|合同|诉讼|行政(处罚|许可|复议)|侵权|继承|物权|仲裁|犯罪"),
    ("common-econ", "常识判断", None, r"经济|市场|通货|货币|GDP|财政|税|利率|汇率|供求|价格|金融|股"),
    ("common-hist", "常识判断", None, r"朝|皇帝|战争|战役|历史|古代|革命|起义|条约|运动|变法|王朝"),
    ("common-geo", "常识判断", None, r"气候|河流|山脉|地形|高原|盆地|海拔|季风|洋流|板块|地震|火山|纬度"),
    ("common-sci", "常识判断", None, r"科学|物理|化学|生物|技术|卫星|航天|细胞|基因|病毒|能源|电|光|声|原理|反应"),
    ("common-hum", "常识判断", None, r"诗|词|作者|文学|小说|成语|节日|戏|书法|绘画|典故|称谓|乐"),
    ("common-other", "常识判断", None, r""),
    ("pol-xi", "政治理论", None, r"习近平|新时代|新思想"),
    ("pol-20th", "政治理论", None, r"二十大|中国式现代化|二十届"),
    ("pol-phil", "政治理论", None, r"哲学|矛盾|辩证|唯物|唯心|意识|实践|认识|规律|量变|质变"),
    ("pol-party", "政治理论", None, r"党史|党的建设|从严治党|会议|决议|党章|纪律"),
    ("pol-econ", "政治理论", None, r"新发展理念|新发展格局|新质生产力|高质量发展|共同富裕"),
    ("pol-other", "政治理论", None, r""),
]

# Score weight per module, reference seconds per sub-type and per module.
SCORE_WEIGHTS = {"政治理论": 0.7, "常识判断": 0.6, "言语理解与表达": 0.8, "数量关系": 0.9, "判断推理": 0.8, "资料分析": 1.0}
TARGET_SECONDS = {"政治理论": 30, "常识判断": 35, "逻辑填空": 40, "片段阅读": 60, "语句表达": 60, "数学运算": 75, "数字推理": 50,
                  "图形推理": 45, "定义判断": 50, "类比推理": 30, "逻辑判断": 70, "资料分析": 70}
MODULE_TARGET = {"政治理论": 30, "常识判断": 35, "言语理解与表达": 50, "数量关系": 75, "判断推理": 50, "资料分析": 70}

# Themes of collected snippets.
THEMES = [
    ("民生保障", r"民生|就业|养老|住房|社保|收入|获得感|幸福感|托育|一老一小|弱有所扶|老有所|病有所|学有所|共同富裕|兜底"),
    ("乡村振兴", r"乡村|农村|农业|农民|三农|粮食|耕地|脱贫|扶贫|种业|村民|驻村|田"),
    ("基层治理", r"基层|社区|网格|减负|形式主义|官僚主义|枫桥|村干部|乡镇|街道|接诉即办"),
    ("生态文明", r"生态|绿色|环保|碳|污染|绿水青山|美丽中国|节能|低碳|垃圾分类|河长|森林|湿地|自然"),
    ("科技创新", r"科技|创新|人工智能|芯片|新质生产力|研发|核心技术|科学家|航天|卡脖子|创造"),
    ("数字经济", r"数字|互联网|网络|平台经济|数据|电商|直播|算法|智慧|信息化|5G"),
    ("文化自信", r"文化|传统|文明|非遗|文物|传承|中华优秀|文艺|阅读|典籍|汉字|博物馆|诗词"),
    ("法治建设", r"法治|法律|执法|司法|依法|规则|守法|普法|宪法|公平正义|法规"),
    ("营商环境", r"营商|民营|市场主体|放管服|政务服务|一网通办|企业家|中小企业|最多跑一次"),
    ("经济发展", r"经济|高质量发展|消费|内需|产业|制造|新发展格局|实体|金融|供给侧|市场"),
    ("教育人才", r"教育|学校|学生|教师|双减|职业教育|育人|人才|高校|立德树人"),
    ("医疗健康", r"医疗|医院|医生|健康|医保|卫生|疫情|公共卫生|中医|药"),
    ("青年担当", r"青年|青春|年轻|后浪|少年|新时代青年"),
    ("党建作风", r"党|作风|廉|初心|使命|为民|公仆|自我革命|腐|干部担当|担当作为|调查研究|群众路线"),
    ("安全应急", r"安全|应急|风险|防灾|减灾|消防|安全生产|国家安全|食品安全"),
    ("精神品质", r"精神|品格|坚守|奉献|工匠|劳模|奋斗|自强|诚信|家风|实干|责任|担当|坚持|毅力|初心"),
    ("对外开放", r"开放|一带一路|人类命运共同体|全球|国际|合作共赢|世界|外交"),
    ("社会治理", r"社会治理|治理|老龄|网络空间|志愿|公益|社会组织|共建共治共享|矛盾纠纷"),
]

# Subjects of a file path.
SUBJECTS = [
    ("言语", r"言语|片段阅读|逻辑填空|语句|成语|词语|实词"),
    ("数量", r"数量|数学|数资|数推|蒙题"),
    ("判断", r"判断|图推|图形|类比|逻辑|定义"),
    ("资料", r"资料分析|资料-|资料刷|数资|高照|速算"),
    ("常识", r"常识|省情|时政|政治理论|政治-"),
    ("申论", r"申论|范文|公文|金句|规范词|热点"),
    ("面试", r"面试|结构化"),
]

# Tags of case-analysis tasks (matched without regard to case).
CASE_TAGS = [
    ("质量属性与评估", r"(?i)质量属性|效用树|敏感点|权衡点|风险点|ATAM|SAAM|架构评估|心跳|Ping"),
    ("嵌入式", r"(?i)嵌入式|实时操作|RTOS|FACE|宇航|AADL|机载|航电|DO-178|可靠性设计|余度|故障检测"),
    ("数据库与缓存", r"(?i)数据库|Redis|缓存|分布式锁|分库|分表|NoSQL|反规范化|关系模式|读写分离|主从|一致性"),
    ("系统建模", r"(?i)UML|用例|类图|顺序图|序列图|数据流图|DFD|状态图|活动图|ER\s*图|E-R|实体联系"),
    ("Web 与云原生", r"(?i)Web|负载均衡|微服务|容器|Kubernetes|云原生|Serverless|JWT|Session|大数据|Lambda|Kappa|Hadoop|MVC|SOA|ESB"),
    ("架构设计", r"(?i)架构风格|架构设计|分层|事件驱动|黑板|管道|解释器|C/S|B/S|中间件|构件"),
    ("安全", r"(?i)安全|加密|认证|授权|攻击|防火墙"),
]

# Task types of essay questions, in order; the question text decides.
ESSAY_TYPES = [
    ("大作文", [has("q", r"文章|议论文|作文|自拟题目|自选角度")]),
    ("贯彻执行", [has("q", r"拟写|起草|撰写|写一篇|写一份|讲话稿|发言稿|倡议书|提案|简报|编者按|宣传稿|短评|公开信|导言|讲解稿|说明|提纲|报告|建议书|方案|材料|稿"),
              has("q", r"假如你是|假设你是|作为|请你|以.{0,10}身份")]),
    ("提出对策", [has("q", r"建议|对策|措施|怎么办|如何解决|解决.{0,6}问题|做法.{0,4}借鉴")]),
    ("综合分析", [has("q", r"分析|理解|谈谈你对|解释|评价|看法|含义|启示|为什么|原因")]),
]

# Topics of news files.
NEWS_TOPICS = [
    ("省情与地方", r"省情|山东"),
    ("两会与政府工作报告", r"政府工作报告|ZF工作报告|两会"),
    ("中央一号文件与三农", r"一号文件|农业|农村|乡村|三农"),
    ("全会与“十五五”规划", r"全会|十五五|二十大|20大|党的.{0,2}大"),
    ("经济与金融工作会议", r"经济工作会议|经济会议|金融工作会议|金融热点|经济"),
    ("新年贺词与重要讲话", r"新年贺词|团拜会|春晚|讲话|总工会"),
    ("法律热点", r"法律|刑法|民法|诉讼法|处罚法|新法|公安"),
    ("党建与理论", r"党建|D建|求是|思想|党史"),
    ("外交与“一带一路”", r"一带一路|外交|峰会"),
    ("纪念日与体育文化", r"抗日战争|抗战|周年|奥运|春晚"),
    ("城市、基层与民生", r"城市|基层|社区|医疗|教育|会计|科技|国防|军队"),
]


def idiom_options(options):
    """At least 60% of the option words are four-character idioms."""
    words = F.filter(F.flatten(F.transform(options, lambda o: F.split(F.coalesce(o, F.lit("")), r"(?U)[，,、\s]+"))),
                     lambda w: w != "")
    four = F.size(F.filter(words, lambda w: w.rlike(r"^[一-鿿]{4}$")))
    return F.coalesce((F.size(words) > 0) & (four >= F.size(words) * 0.6), F.lit(False))


def topic_of(module, sub, stem, options=None, rules=TOPIC_RULES):
    """Topic id of a question: the first rule of its module (and sub-type) whose pattern is found in the stem."""
    text, case = F.coalesce(stem, F.lit("")), None
    for tid, mod, rsub, rx in rules:
        cond = module == mod
        if rsub:
            cond = cond & (sub == rsub)
        if rx == IDIOM:
            cond = cond & (idiom_options(options) if options is not None else F.lit(False))
        elif rx:
            cond = cond & text.rlike("(?U)" + rx)
        case = F.when(cond, tid) if case is None else case.when(cond, tid)
    return case.otherwise("")
