"""Texts that results must carry and markers that decide about posts. Callers may pass lists of their own.

Subject aliases, rules and addresses are always the caller's.
"""

FEED, LIST, VIDEO, ARTICLE, FORUM = "QQ 공식 채널", "TapTap", "Bilibili", "위챗 공식계정", "Baidu Tieba"
MAIN_SECTION_ID = "hot"
EVENT_SECTIONS = ["活动专区", "故事征集"]
CAMPAIGN_AUTHORS = ["锦鲤传递官"]
CAMPAIGN_MARKERS = ["#我们的故事", "#ourstory", "#covenantparadise2covenant", "#战盟的狩猎时刻", "#锦鲤传递官", "#游戏封神名场面", "#今天打宝出了什么", "参与话题活动赢q币奖励"]
LOW_SIGNAL = ["分享图片", "分享视频", "爽", "终于到我了", "来了", "路过"]
ONLY_IMAGES, ONLY_VIDEOS = "分享图片", "分享视频"
OFFICIAL_MARKERS = ["管理", "官方", "客服", "策划", "运营", "版主", "值班", "小助手", "小秘书", "GM"]
ROUNDUP_MARKERS = [
    "手游榜", "手游资讯", "手游新闻", "手游日报", "手游早报", "手游推荐", "手游盘点", "手游目录", "手游省钱",
    "手游折扣", "手游特惠", "游戏资讯", "游戏新闻", "游戏日报", "游戏早报", "游戏盘点", "新游推荐",
]
STOP_LINES = [
    "下载手机 APP", "下载手机APP", "下载 TapTap", "下载TapTap", "扫码下载", "Android APK 下载", "App Store 下载",
    "下载 PC 版", "TapTap PC 版", "Windows 版下载", "Mac 版下载", "前往论坛", "相关推荐", "热门游戏论坛",
]
SEEN, LIKE, FOLLOW, SEARCH_TAIL = "浏览", "点赞", "关注", "猜你想搜|相关搜索"
NO_AUTHOR = "浏览|下载|TapTap"
PLACEHOLDERS = ["-", "--", "无", "暂无简介", "暂无介绍"]
STOPWORDS = [
    "什么", "这个", "那个", "我们", "你们", "他们", "没有", "可以", "就是", "现在", "怎么", "这样", "那样", "一个", "自己", "时候",
    "知道", "感觉", "真的", "大家", "已经", "还是", "不是", "但是", "因为", "所以", "如果", "这么", "那么", "一下", "有点", "觉得",
    "希望", "请问", "到底", "而且", "或者", "应该", "可能", "一直", "为什么", "怎么办", "有没有", "是不是", "这是", "还有", "然后",
    "一样", "东西", "开始", "结束", "以后", "之后", "之前", "时间", "问题", "情况", "谢谢", "各位", "兄弟", "老哥", "求助", "请教",
]
UNKNOWN = "미확인"
SCOPES = {
    "feed": "게시글 피드 텍스트 전체(이미지·댓글 제외)", "card": "게시글 텍스트 전체(이미지·댓글 제외)", "detail": "게시글 상세 텍스트 전체(이미지·댓글 제외)",
    "page": "게시글 본문 전체", "title": "제목만(본문 미확인)", "article": "위챗 공식계정 글 본문(이미지 제외)", "floor": "첫 게시글 본문 전체",
    "video": "영상 설명 전체", "video title": "영상 제목만(설명 없음)",
}
NOTES = {
    "feed": "QQ 날짜순 공개 게시판 · 원본 createTime 기준", "card": "QQ 공개 웹 표본 · JSON-LD datePublished 기준", "card undated": "QQ 공개 웹 표본 · 실제 게시일 미확인",
    "detail": "QQ 날짜순 공개 게시판 · 상세 datePublished 재검증", "detail undated": "QQ 날짜순 공개 게시판 · 상세 게시일 확인 실패", "page": "TapTap 개별 게시글 공개 페이지",
    "article": "소구 위챗 검색으로 찾은 공개 글 · 원문 링크는 시간이 지나면 만료될 수 있음", "floor": "Baidu Tieba 개별 게시글 공개 페이지", "video": "Bilibili 공개 검색·영상 정보 API",
}
DATED_BY = {
    "feed": "QQ feed createTime (Asia/Shanghai)", "card": "QQ JSON-LD datePublished", "detail": "QQ 상세 JSON-LD datePublished", "page": "TapTap JSON-LD datePublished",
    "page shown": "TapTap 개별 글 표시 날짜", "article": "위챗 글 작성 시각", "article found": "검색 결과 표시 시각", "video": "Bilibili API pubdate",
}
#: Labels and messages of results.
TITLE_LABEL, BODY_LABEL, FAILED = "제목", "본문", "번역 실패"
EXCLUDED_NAMES = {"campaign": "이벤트성", "low_signal": "저정보"}
GRID = {
    "date": "일자", "source": "출처", "category": "주 분류", "content_type": "글 유형", "analysis_role": "분석 용도", "content_scope": "수집 범위", "source_section": "원문 섹션",
    "published_at_source": "게시일 기준", "title_ko": "한국어 제목", "views": "조회", "engagement": "댓글/반응", "url": "원문",
}
EXPORT = [
    "date", "source", "category", "all_categories", "content_type", "analysis_role", "trend_eligible", "title", "title_ko", "original_text", "translated_text", "content_scope",
    "source_note", "source_section", "published_at_source", "is_official", "is_campaign", "is_low_signal", "keyword_text", "views", "engagement", "author", "url", "translation_error",
]
