"""Word lists, tables and patterns that results depend on."""

from __future__ import annotations

# --- fixed values: event types, roles, levels, defaults -------------------------------------
EVENT_TYPES = ["灾害/事故", "政策/发布", "经济/涨跌", "社会/舆情"]
ROLES = ["subject", "object", "time", "location", "instrument", "manner", "result"]
DEFAULT_EVENT_TYPE = "社会/舆情"
DIRECT, INDIRECT = "直接因果", "间接传导"
LEVEL_CONFIDENCE = {"certain": 0.9, "probable": 0.65, "possible": 0.45, "likely": 0.6, "uncertain": 0.3}
DEFAULT_LEVEL_CONFIDENCE = 0.6

# --- fixed values: triggers of each event type, in the order that breaks ties ----------------
TRIGGERS = {
    "灾害/事故": ["发生", "遭遇", "导致", "造成", "引发", "爆发", "抛锚", "瘫痪", "受阻", "伤亡", "坠毁", "坍塌", "泄漏", "泄露", "起火", "爆炸", "相撞", "翻车", "倒塌", "内涝", "积水", "事故"],
    "政策/发布": ["宣布", "出台", "颁布", "发布", "签署", "任命", "选举", "召开", "会见", "会谈", "签约", "推出", "实施", "通过"],
    "经济/涨跌": ["上涨", "下跌", "下降", "涨价", "降价", "飙升", "暴跌", "裁员", "融资", "上市", "收购", "破产", "倒闭", "亏损", "盈利", "增长", "下滑"],
    "社会/舆情": ["抗议", "集会", "罢工", "游行", "投诉", "维权", "拘捕", "起诉", "开庭", "审判", "处罚", "斗殴", "纠纷", "失联", "曝光", "传播"],
}

# --- fixed values: patterns of times, places, instruments and manners -------------------------
SENTENCE_END = "[。！？；!?;\\n]"
SIMPLE_SENTENCE_END = "[。！？；\\n]"
TIME = r"\d{1,4}年\d{1,2}月\d{1,2}日|\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
LOCATION = "[一-龥]{1,4}(?:省|市|县|区|镇|乡|村|国)(?![民场域界长委局府人员家])"
LOCATION_LEAD = "据个性对向从将把与和到于由为的在此其"
INSTRUMENT = "(?:(?<![信应通日费急军公民两])用|利用|使用|采用|通过|凭借|借助|依靠|经由)([一-龥A-Za-z0-9]{1,10})"
MANNER = "(?:以|用)([一-龥]{1,10}?)(?:的)?(?:方式|方法|手段|态度|速度|形式|途径|模式)"
SKIPPED_NOUNS = [
    "部分", "一些", "许多", "大量", "若干", "不少", "全部", "所有", "其他", "其它", "该", "这", "那", "这些", "那些", "某", "每", "各", "本", "此", "上述", "以下",
    "他", "她", "它", "他们", "她们", "它们", "我们", "你们", "其", "之", "一", "两", "几", "数", "多", "少", "众多", "多名", "多人", "此次", "本次", "时", "环比", "同比",
]

# --- fixed values: fine event types of each team type, then ordered keyword rules ---------------
FINE_TYPES = {
    "灾害/事故": ["灾害/意外-爆炸", "灾害/意外-车祸", "灾害/意外-地震", "灾害/意外-洪灾", "灾害/意外-起火", "灾害/意外-坍/垮塌", "灾害/意外-袭击", "灾害/意外-坠机"],
    "经济/涨跌": [
        "财经/交易-出售/收购", "财经/交易-跌停", "财经/交易-加息", "财经/交易-降价", "财经/交易-降息", "财经/交易-融资", "财经/交易-上市", "财经/交易-涨价", "财经/交易-涨停",
        "组织关系-裁员", "组织关系-辞/离职", "组织关系-加盟", "组织关系-解雇", "组织关系-解散", "组织关系-解约", "组织关系-停职", "组织关系-退出",
    ],
    "政策/发布": ["产品行为-发布", "产品行为-获奖", "产品行为-上映", "产品行为-下架", "产品行为-召回", "组织行为-开幕", "组织行为-闭幕", "交往-会见"],
    "社会/舆情": [
        "交往-道歉", "交往-点赞", "交往-感谢", "交往-探班", "竞赛行为-夺冠", "竞赛行为-晋级", "竞赛行为-禁赛", "竞赛行为-胜负", "竞赛行为-退赛", "竞赛行为-退役",
        "人生-产子/女", "人生-出轨", "人生-订婚", "人生-分手", "人生-怀孕", "人生-婚礼", "人生-结婚", "人生-离婚", "人生-庆生", "人生-求婚", "人生-失联", "人生-死亡",
        "司法行为-罚款", "司法行为-拘捕", "司法行为-举报", "司法行为-开庭", "司法行为-立案", "司法行为-起诉", "司法行为-入狱", "司法行为-约谈", "组织行为-罢工", "组织行为-游行",
    ],
}
TYPE_RULES = [
    ("灾害/事故", ["灾害", "地震", "火灾", "车祸", "事故", "意外", "爆炸", "疫情", "伤亡", "暴雨", "洪水", "泥石流", "坠毁", "坍塌", "泄漏", "泄露", "污染", "台风", "干旱", "雪崩", "海啸", "内涝"]),
    ("经济/涨跌", ["经济", "财经", "涨", "跌", "裁员", "融资", "上市", "收购", "交易", "投资", "破产", "并购", "降价", "涨价", "业绩", "亏损", "盈利", "降薪", "解散", "倒闭", "市值", "股价", "减持", "增持"]),
    ("政策/发布", ["政策", "发布", "宣布", "出台", "颁布", "法规", "会议", "会见", "会谈", "签约", "外交", "任命", "换届", "选举", "协定", "声明", "召见", "访问", "提案", "决议"]),
    ("社会/舆情", ["社会", "舆情", "抗议", "集会", "舆论", "传播", "投诉", "维权", "犯罪", "案件", "处罚", "拘捕", "开庭", "起诉", "审判", "罢工", "游行", "群体", "纠纷", "斗殴", "失联"]),
]

# --- fixed values: fine roles of each role, then ordered keyword rules ----------------------------
FINE_ROLES = {
    "time": ["时间", "禁赛时长", "刑期", "生日方年龄", "死者年龄"],
    "location": ["地点", "震中", "开庭法院"],
    "manner": ["融资轮次"],
    "subject": [
        "出售方", "收购方", "加息机构", "降价方", "降息机构", "跟投方", "领投方", "融资方", "上市企业", "涨价方", "发布方", "获奖人", "颁奖机构", "上映方", "下架方", "召回方",
        "道歉者", "点赞方", "致谢人", "会见主体", "探班主体", "冠军", "晋级方", "禁赛机构", "败者", "胜者", "退赛方", "退役者", "产子者", "出生者", "出轨方", "订婚主体", "分手双方",
        "怀孕者", "参礼人员", "结婚双方", "离婚双方", "生日方", "庆祝方", "求婚者", "失联者", "死者", "执法机构", "拘捕者", "举报发起方", "立案机构", "被告", "原告", "入狱者",
        "约谈发起方", "袭击者", "裁员方", "离职者", "原所属组织", "加盟者", "所加盟组织", "解雇方", "解散方", "解约方", "所属组织", "退出方", "罢工人员", "游行组织",
    ],
    "object": [
        "交易物", "出售价格", "跌停股票", "加息幅度", "降价物", "降价幅度", "降息幅度", "融资金额", "涨价幅度", "涨价物", "涨停股票", "发布产品", "奖项", "上映影视", "下架产品", "被下架方",
        "召回内容", "道歉对象", "点赞对象", "被感谢人", "会见对象", "探班对象", "夺冠赛事", "晋级赛事", "被禁赛人员", "赛事名称", "退赛赛事", "出轨对象", "求婚对象", "罚款对象", "罚款金额",
        "被拘捕者", "举报对象", "开庭案件", "立案对象", "约谈对象", "死亡人数", "受伤人数", "震级", "震源深度", "坍塌主体", "袭击对象", "裁员人数", "被解雇人员", "被解约方", "停职人员",
        "罢工人数", "活动名称", "游行人数",
    ],
}
ROLE_RULES = [
    ("time", ["时间", "日期", "时刻", "年月", "日"]),
    ("location", ["地点", "地区", "城市", "国家", "场所", "位置", "行政区", "国"]),
    ("object", ["人数", "对象", "客体", "被", "受害者", "受害", "金额", "数量", "内容", "标的", "数目"]),
    ("subject", ["方", "者", "机构", "公司", "主体", "人", "发起", "施"]),
    ("instrument", ["工具", "手段", "设备", "载体", "武器"]),
    ("manner", ["方式", "程度", "态度", "途径"]),
    ("result", ["结果", "后果", "影响", "损失", "造成"]),
]

# --- fixed values: relation inference ---------------------------------------------------------------
CAUSAL_CUES = [
    "导致", "造成", "引发", "引起", "促使", "促发", "诱发", "触发", "致使", "进而", "因此", "为此", "鉴于", "受此", "随之", "随后", "继而", "从而",
    "连锁", "传导", "推动", "倒逼", "连带", "起因于", "原因是", "由于",
]
DIRECT_CUES = ["导致", "造成", "引发", "引起", "促使", "诱发", "触发", "致使", "推动"]
DISTRACTOR = "(例行|常规|邻近|周边辖区|无关).{0,12}(演练|演习)|演练.{0,8}(例行|常规)"
NONCAUSAL_TYPE = "综合汇编|多阶段汇编|矛盾来源|背景信息"
NONCAUSAL_TEXT = "多阶段汇编|综合调查报道"
STAGES = ["事故发生", "现场救援", "官方部署", "原因调查", "责任追究", "善后处置", "隐患分析", "专项整治", "行业转型", "调查报告"]
STAGE_EDGES = [
    (1, 2, 0.9), (1, 3, 0.65), (2, 3, 0.9), (3, 4, 0.9), (4, 5, 0.9), (4, 6, 0.9), (5, 7, 0.65), (6, 7, 0.65), (6, 8, 0.9), (7, 9, 0.65), (8, 9, 0.9), (8, 10, 0.65),
]
DIRECT_CONFIDENCE, INDIRECT_CONFIDENCE, CUE_BOOST, MOST_CONFIDENCE = 0.75, 0.55, 0.12, 0.95

# --- fixed values: question directions ----------------------------------------------------------------
BACKWARD_CUES = ["什么导致", "是什么导致", "为什么", "的原因", "起因", "因为什么", "由于什么", "怎么造成"]
FORWARD_CUES = ["导致", "引发", "造成", "引起", "会怎么样", "会怎样", "可能", "接下来", "后果"]

# --- fixed values: packs ---------------------------------------------------------------------------------
STAGE_WORDS = [
    ("事故发生", ["事故发生", "突发", "发生事故", "空难", "坠毁", "爆炸", "起火", "坍塌", "塌方", "泄漏", "泄露", "地震", "洪水", "暴雨", "内涝", "台风", "危机", "撞击", "相撞", "遇难", "伤亡", "受灾", "感染疫情"]),
    ("现场救援", ["救援", "搜救", "抢险", "抢救", "获救", "救出", "应急联动", "赶赴现场", "医疗队", "消防", "绿色通道"]),
    ("官方部署", ["启动应急", "部署", "成立.*指挥", "紧急会议", "召开.*会议", "应急响应", "工作组.*赴", "交通管制", "下令", "批示"]),
    ("原因调查", ["调查组", "事故调查", "原因.*调查", "初步认定", "查明", "勘查", "调查结果", "认定.*原因", "排查.*隐患.*调查"]),
    ("责任追究", ["责任追究", "追究.*责任", "问责", "立案", "强制措施", "刑事拘留", "批捕", "起诉", "处罚", "责任人"]),
    ("善后处置", ["善后", "安抚", "补偿", "赔偿", "抚恤", "安置", "救助", "理赔"]),
    ("隐患分析", ["隐患", "违规操作", "管理漏洞", "短板", "缺陷", "薄弱环节", "管理缺失", "设备故障", "操作失误"]),
    ("专项整治", ["专项整治", "排查整治", "整改", "整治行动", "专项排查", "全面整改", "标准修订", "加强监管", "堵塞漏洞"]),
    ("行业转型", ["转型", "系统性提升", "升级", "推动.*行业", "高质量发展", "产业调整", "新模式"]),
    ("调查报告", ["调查报告", "报告发布", "报告公布", "调查结论"]),
]
PACK_TIME = r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
PACK_LOCATION = "[一-龥]{2,5}(?:省|市|县|区|镇|乡|州|海|峡|洋)"
PACK_ORGANISATION = "[一-龥A-Za-z0-9]{2,12}?(?:部门|指挥部|工作组|委员会|管理局|交通部|运输部|应急部|政府|公司|集团|企业|武装组织?)"
IMPACT_CUES = ["造成", "导致", "致使", "影响", "伤亡", "遇难", "损失", "暴涨", "短缺", "中断", "停业", "停课", "停运"]
DIGEST_HEAD = r"【\s*([DE]\s*\d{3,4})\s*[·•・:：]\s*([^】]{2,16}?)】"
DIGEST_TITLE = "综合.{0,8}(报道|汇编)|多阶段汇编"
CONFLICT = "存在出入|尚未一致|交叉核验|相互矛盾|数据不一致|口径.{0,8}为"
BACKGROUND = "无直接因果关系|仅作背景参考|并无关联|并无因果"
SPECIAL_LABELS = {"digest": "综合汇编", "conflict": "矛盾来源", "background": "背景信息"}
EVIDENCE_CUES = ["导致", "造成", "引发", "引起", "促使", "进而", "因此", "为此", "随之", "随后", "继而", "从而", "推动", "由于", "起因"]
ID = r"D(\d{3,4})"
ID_LABEL = r"D(\d{3,4})[（(]\s*([^）)]{1,20}?)\s*[）)]"
DOCUMENT_FILE = r"(?i)D(\d+)\.txt$"
EVENTS_FILE, RELATIONS_FILE, QUESTIONS_FILE = "事件列表.json", "事件因果关系列表.json", "问题.json"

# --- fixed values: calibration ----------------------------------------------------------------------------
CALIBRATION = {
    "multi_hop_causal": {0.9: 0.42, 0.8: 0.45, 0.7: 0.43, 0.6: 0.04, 0.4: 0.07},
    "temporal_causal": {0.9: 0.32, 0.8: 0.40, 0.7: 0.17, 0.4: 0.26},
    "grounded_pred": {0.8: 0.22, 0.7: 0.23, 0.6: 0.33},
    "single_hop": {0.9: 0.25, 0.6: 0.25, 0.4: 0.20, 0.3: 0.12},
    "counterfactual": {0.8: 0.21, 0.7: 0.21, 0.6: 0.11, 0.4: 0.10},
    "distractor_robustness": {0.5: 0.30},
    "conflicting_sources": {0.5: 0.09, 0.4: 0.09},
    "missing_information": {0.4: 0.12},
    "unanswerable": {0.4: 0.05},
    "summary": {0.5: 0.10},
}
CALIBRATION_BASE = {
    "multi_hop_causal": 0.41, "temporal_causal": 0.31, "grounded_pred": 0.30, "single_hop": 0.25, "counterfactual": 0.20,
    "distractor_robustness": 0.30, "conflicting_sources": 0.10, "missing_information": 0.12, "unanswerable": 0.05, "summary": 0.10,
}
