"""The texts of the requests to a language model, with ``{fields}``; callers may pass their own."""

#: Extraction of attributes from numbered conversations: ``{n}``, ``{person}``, ``{convs}``.
EXTRACT_PROMPT = """
    You are an expert at analyzing conversations and extracting personal attributes and facts about people.
    
    I'll provide you with {n} conversations involving {person}. Your task is to:
    
    1. Extract specific attributes and facts about {person} from these conversations. Do not extract traits, opinions on personality, etc.
    2. Focus on persistent attributes (like hobbies, background, relationships) rather than one-time events. 
    
    For example: if Ben is currently in a research project in AI, you should extract that "Ben does research in AI.", not "Ben is currently in a research project in AI".

    3. For each attribute, cite a specific message from the conversations where this information appears.
    4. Include the timestamp of when this information was mentioned.
    5. Format each attribute as a clear, concise statement about {person}.
    6. IMPORTANT: Always include the exact conversation number in your citation (e.g., "Conversation 2").
    
    Examples of good attributes:
    - "{person} went to high school in Morgantown, West Virginia at Morgantown High School." (Citation: Conversation 2, {person}: "I grew up in Morgantown and went to high school there at Morgantown High School.", Timestamp: "2023-05-15 14:30")
    - "{person} has a dog named Ellie." (Citation: Conversation 1, {person}: "I need to take Ellie, my dog, for a walk later.", Timestamp: "2023-06-02 09:15")
    - "{person} likes to create music." (Citation: Conversation 3, Friend: "How's your music production going? I need to hear some banger songs again.", Timestamp: "2023-04-28 18:45")
    - "{person} played tennis on his high school team." (Citation: Conversation 1, {person}: "I miss playing tennis competitively like I did in high school.", Timestamp: "2023-05-10 11:20")
    
    Please format your response EXACTLY as follows, with each attribute having these three lines:
    
    - Attribute: {person} went to high school in Morgantown, West Virginia.
    - Citation: Conversation 2, {person}: "I grew up in Morgantown and went to high school there."
    - Timestamp: 2023-05-15 14:30
    
    - Attribute: {person} has a dog named Ellie.
    - Citation: Conversation 1, {person}: "I need to take Ellie, my dog, for a walk later."
    - Timestamp: 2023-06-02 09:15
    
    Here are the conversations:
    
    {convs}
    """

#: Combination of numbered attributes: ``{person}``, ``{attrs}``.
COMBINE_PROMPT = """
    You are an expert at analyzing personal information and making connections between related facts.
    
    I'll provide you with a list of attributes about {person} that were extracted from conversations.
    Your task is to:
    
    1. Identify and combine attributes that are talking about the same thing but might be phrased differently or contain complementary information.
    2. Infer new attributes that can be reasonably deduced by combining existing attributes.
    
    For example:
    - If one attribute says "{person} studies at Stanford" and another says "{person} is majoring in Computer Science", 
      you might combine them as "{person} studies Computer Science at Stanford".
    - If attributes mention "{person} grew up in Seattle" and "{person} moved to Boston for college", 
      you might infer "{person} relocated from the West Coast to the East Coast for higher education".
    
    Please format your response EXACTLY as follows, with two clearly labeled sections:

    COMBINED ATTRIBUTES:
    - Attribute: {person} studies Computer Science at Stanford.
    - Based on: Attribute 3, Attribute 7
    
    - Attribute: {person} has been playing piano for over 10 years and performs in local venues.
    - Based on: Attribute 12, Attribute 15
    
    INFERRED ATTRIBUTES:
    - Attribute: {person} relocated from the West Coast to the East Coast for higher education.
    - Based on: Attribute 2, Attribute 9
    
    - Attribute: {person} likely has an interest in both technology and music.
    - Based on: Attribute 3, Attribute 12
    
    Here are the attributes about {person}:
    
    {attrs}
    """

#: Event memories from a chunk of attributes as JSON: ``{person}``, ``{chunk}``, ``{total}``, ``{json}``.
EVENT_PROMPT = """
            You are tasked with creating event-based memories about {person} based on the attributes provided.
            
            IMPORTANT: Focus on specific events, experiences, and time periods in {person}'s life, NOT general traits or characteristics.
            
            Good examples (These are made up, do not use them as examples):
            - "{person} attended Morgantown High School from 2016 to 2020, where he was part of the quiz bowl team and developed a strong interest in chemistry thanks to his favorite teacher, Mr. Johnson."
            - "During summer 2023, {person} traveled to Las Vegas with friends Alex and Jordan, where they attended a music festival and {person} won $200 at blackjack."
            - "In Fall 2022, {person} began working on his first major AI research paper with Professor Zhang, focusing on personalized AI models, which was later published in March 2023."
            
            Bad examples (too general, not event-based):
            - "{person} enjoys playing video games like Stardew Valley."
            - "{person} is interested in AI research and collaborates with friends."
            - "{person} values financial management and budgeting."
            
            For each memory:
            1. Focus on specific events, time periods, or experiences
            2. Include relevant details like when it happened, who was involved, and what specifically occurred
            3. Organize memories chronologically when possible
            4. Cite which attributes this memory is based on
            
            Here are the attributes to work with (chunk {chunk} of {total}):
            
            {json}
            
            Return your response as a JSON array of objects, each with:
            - "attribute": The detailed event-based memory
            - "citation": References to the attributes this is based on (e.g., "Original Attribute 5, Combined Attribute 2")
            - "timestamp": Approximate time period if known (e.g., "Summer 2023", "2016-2020", "March 2023")
            
            Create up to 5 high-quality, event-based memories from this chunk of attributes.
            """
